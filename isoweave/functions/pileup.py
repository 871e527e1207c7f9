"""Alignment columns to votes: CIGAR and MD of one alignment, read as strings of columns."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CIGAR = re.compile(r"(\d+)(\w)")
MD = re.compile(r"\^[A-Z]+|[A-Z]|\d+")
CLIPS = re.compile(r"(S*)([^S]*)(S*)")


def expand(cigar: str, seq: str) -> tuple[str, str]:
    """One operation and one read base (`_` for a deletion) for each column."""
    ops = "".join(op * int(n) for n, op in CIGAR.findall(cigar))
    bases = iter(seq)
    return ops, "".join("_" if op == "D" else next(bases, "") for op in ops)


def overlay(ops: str, read: str, md: str) -> str:
    """Columns where the MD tag states a mismatch get the read's base.

    A leading run counts M columns alone, later runs M and D columns. An insertion that ends a run is
    not skipped, so a mismatch right behind it falls on the inserted column; a deleted stretch moves
    on by its length from wherever the run has ended.
    """
    lead = [i for i, op in enumerate(ops) if op == "M"]
    later = [i for i, op in enumerate(ops) if op in "MD"]
    out, at = list(ops), 0
    for k, token in enumerate(MD.findall(md)):
        if token.isdigit():
            runs, n = (lead if k == 0 else later), int(token)
            if n:
                end = bisect_left(runs, at) + n - 1
                at = runs[end] + 1 if end < len(runs) else len(ops)
        elif token[0] == "^":
            at += len(token) - 1
        else:
            if at < len(out) and read[at] != "_":
                out[at] = read[at]
            at += 1
    return "".join(out)


def votes(cigar: str, md: str, seq: str, start: int) -> list[tuple[int, str]]:
    """(position, allele) of an alignment that begins at `start` (from 0).

    Nothing if the clipped ends are longer than what is between them. A column followed by inserted
    ones, or the last, votes for its base with the inserted bases; a deletion there for nothing.
    """
    ops, read = expand(cigar, seq)
    master = overlay(ops, read, md)
    left, middle, right = CLIPS.match(master).groups()
    if len(left) + len(right) > len(middle):
        return []
    read = read[len(left) : len(left) + len(middle)]
    out = []
    for k, m in enumerate(re.finditer(".I*", middle)):
        first, base = m.group()[0], read[m.start()]
        if m.end() == m.start() + 1 < len(middle):
            allele = {"D": "Del", "M": base}.get(first, first)
        else:
            own = first if first in "ATCG" else base.replace("_", "")
            allele = own + read[m.start() + 1 : m.end()].replace("_", "")
        out.append((start + k, allele))
    return out


class Alleles:
    """Alleles as whole numbers: single letters by their code, others in the order met."""

    def __init__(self) -> None:
        self.names = [chr(i) for i in range(256)]
        self.codes: dict[str, int] = {c: i for i, c in enumerate(self.names)}

    def __call__(self, allele: str) -> int:
        if allele not in self.codes:
            self.codes[allele] = len(self.names)
            self.names.append(allele)
        return self.codes[allele]


M, I, D, S = (ord(c) for c in "MIDS")


def overlaid(ops: np.ndarray, read: np.ndarray, md: str) -> np.ndarray:
    """overlay() on arrays of letters."""
    tokens = MD.findall(md)
    if len(tokens) == 1 and tokens[0].isdigit():
        return ops
    lead, later, out, at = np.flatnonzero(ops == M), np.flatnonzero((ops == M) | (ops == D)), ops.copy(), 0
    for k, token in enumerate(tokens):
        if token.isdigit():
            runs, n = (lead if k == 0 else later), int(token)
            if n:
                end = int(np.searchsorted(runs, at)) + n - 1
                at = int(runs[end]) + 1 if end < len(runs) else len(ops)
        elif token[0] == "^":
            at += len(token) - 1
        else:
            if at < len(out) and read[at] != ord("_"):
                out[at] = read[at]
            at += 1
    return out


def coded_votes(cigar: str, md: str, seq: str, alleles: Alleles) -> np.ndarray:
    """votes() as an array of allele codes, for the positions from the start on."""
    steps = CIGAR.findall(cigar)
    ops = np.repeat(np.array([ord(op) for _, op in steps], np.uint8), [int(n) for n, _ in steps]) if steps and cigar.isascii() else np.zeros(0, np.uint8)
    takes = ops != D
    used = int(takes.sum())
    if not seq.isascii() or not cigar.isascii() or used > len(seq):  # columns without a base: the plain way knows what they are
        return np.array([alleles(a) for _, a in votes(cigar, md, seq, 0)], np.int64)
    read = np.full(len(ops), ord("_"), np.uint8)
    read[takes] = np.frombuffer(seq.encode(), np.uint8)[:used]
    master = overlaid(ops, read, md)
    inner = np.flatnonzero(master != S)
    left = inner[0] if len(inner) else len(master)
    ends = np.flatnonzero(master[left:] == S)
    middle = int(ends[0]) if len(ends) else len(master) - left
    behind = np.flatnonzero(master[left + middle :] != S)
    right = int(behind[0]) if len(behind) else len(master) - left - middle
    if left + right > middle or not middle:
        return np.zeros(0, np.int64)
    master, read = master[left : left + middle], read[left : left + middle]
    first = master != I
    first[0] = True
    at = np.flatnonzero(first)
    stop = np.append(at[1:], middle)
    out = np.where(master[at] == M, read[at], master[at]).astype(np.int64)
    out[master[at] == D] = alleles("Del")
    for k in np.flatnonzero((stop - at > 1) | (stop == middle)):
        letter, base = chr(master[at[k]]), chr(read[at[k]])
        inserted = read[at[k] + 1 : stop[k]].tobytes().decode("latin-1")
        out[k] = alleles((letter if letter in "ATCG" else base.replace("_", "")) + inserted.replace("_", ""))
    return out


def _summed(refs: list[np.ndarray], places: list[np.ndarray], codes: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sums of equal (reference, position, allele), in the order of the keys."""
    r, p, c, w = (np.concatenate(x) for x in (refs, places, codes, weights))
    order = np.lexsort((c, p, r))
    r, p, c = r[order], p[order], c[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (c[1:] != c[:-1])]
    return r[new], p[new], c[new], np.bincount(np.cumsum(new) - 1, weights=w[order])


class Votes:
    """Votes of some alignments, held as arrays."""

    def __init__(self) -> None:
        self.alleles, self.number, self.size, self.repeated = Alleles(), {}, 0, False
        self.parts: list[list[np.ndarray]] = [[], [], [], []]

    def add(self, rname: str, pos: int, cigar: str, md: str, seq: str, weight: float | None) -> None:
        code = coded_votes(cigar, md, seq, self.alleles)
        self.repeated |= rname in self.number
        own = self.number.setdefault(rname, len(self.number))
        columns = np.full(len(code), own, np.int32), np.arange(pos - 1, pos - 1 + len(code), dtype=np.int32), code, np.full(len(code), np.nan if weight is None else weight)
        for x, column in zip(columns, self.parts):
            column.append(x)
        self.size += len(code)

    def sum_up(self) -> None:
        """Positions of one alignment differ, so there is nothing to sum up without a second one."""
        if self.repeated:
            self.parts = [[x] for x in _summed(*self.parts)]
            self.size = len(self.parts[0][0])

    def rows(self) -> pa.RecordBatch:
        self.sum_up()
        r, p, c, w = (np.concatenate(x) for x in self.parts)
        names = pa.array(list(self.number), pa.string()).take(pa.array(r))
        return pa.RecordBatch.from_arrays([names, pa.array(p), pa.array(self.alleles.names, pa.string()).take(pa.array(c)), pa.array(w)], ["id", "pos", "allele", "weight"])


VOTES = "id string, pos int, allele string, weight double"


def pile(alignments: DataFrame, reads: int = 512) -> DataFrame:
    """id, pos, allele, weight from `alignments(rname, flag, pos, cigar, md, seq, weight)`.

    Votes are summed up over `reads` alignments at a time before they go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, reads):
                v = Votes()
                for row in zip(*[c.to_pylist() for c in whole.slice(first, reads).columns]):
                    v.add(*row)
                yield v.rows()

    return _mapped(alignments).mapInArrow(run, VOTES)


def piled(alignments: DataFrame, share: int = 2048, least: int = 10_000, held: int = 1 << 19) -> DataFrame:
    """The sums of all votes of pile() by id, pos and allele.

    Alignments are dealt by their long read, so that votes, which are many more, need no shuffle. Long
    reads with more than one in `share` of all alignments (and `least`) are at most `share` in number;
    their votes are made where the alignments are, and summed up behind a shuffle.
    """
    a = alignments.where(ALIGNED)
    counts = alignments.groupBy("rname").count().where("rname is not null")  # needs no other column
    limit = max(least, (counts.agg(F.sum("count")).first()[0] or 0) // share)
    large = counts.where(F.col("count") > limit).select("rname").collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, last = Votes(), None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[0] != last and v.size > held:
                    yield v.rows()
                    v = Votes()
                last = row[0]
                v.add(*row)
                if v.size > 16 * held:
                    v.sum_up()
        if v.size:
            yield v.rows()

    def settled(rows: DataFrame) -> DataFrame:
        return _mapped(rows).repartition("rname").sortWithinPartitions("rname").mapInArrow(run, VOTES)

    if not large:
        return settled(a)
    names = F.broadcast(a.sparkSession.createDataFrame(large, a.select("rname").schema))
    spread = pile(a.join(names, "rname", "left_semi")).groupBy("id", "pos", "allele").agg(F.sum("weight").alias("weight"))
    return settled(a.join(names, "rname", "left_anti")).unionByName(spread)


ALIGNED = "flag <> 4 and cigar is not null and md is not null and seq is not null"


def _mapped(alignments: DataFrame) -> DataFrame:
    return alignments.where(ALIGNED).select(F.col("rname").cast("string").alias("rname"), F.col("pos").cast("int").alias("pos"), "cigar", "md", "seq", F.col("weight").cast("double").alias("weight"))
