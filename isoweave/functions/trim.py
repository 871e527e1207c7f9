"""Adapter, primer and poly-A trimming of one read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KMER = 6
COMPLEMENT = str.maketrans("ATCG", "TAGC")


def revcomp(seq: str) -> str:
    return seq.translate(COMPLEMENT)[::-1]


def distances(a: str, others: np.ndarray) -> np.ndarray:
    """Levenshtein distance of a to each row of letter codes, all rows at once.

    Up to 63 letters of a are the bits of a word: a column of the table is held as the places where it
    rises and falls by one, and each letter of the rows takes a few word operations.
    """
    letters = a.lower().encode("latin-1", "replace")
    size = len(letters)
    if not 0 < size < 64:
        return _by_rows(letters, others)
    one = np.uint64(1)
    match = np.zeros(256, np.uint64)
    for i, c in enumerate(letters):
        match[c] |= one << np.uint64(i)
    top, full = one << np.uint64(size - 1), (one << np.uint64(size)) - one
    up, down = np.full(len(others), full), np.zeros(len(others), np.uint64)
    far = np.full(len(others), size, np.int64)
    for column in others.T:
        same = match[column]
        across = (((same & up) + up) ^ up) | same | down
        rise, fall = down | ~(across | up), up & across
        far += ((rise & top) != 0).astype(np.int64) - ((fall & top) != 0)
        rise, fall = (rise << one) | one, fall << one
        reach = same | down
        up, down = (fall | ~(reach | rise)) & full, rise & reach & full
    return far


def _by_rows(letters: bytes, others: np.ndarray) -> np.ndarray:
    """The same by one table row at a time, for words of any length."""
    step = np.arange(others.shape[1] + 1)
    row = np.broadcast_to(step, (len(others), len(step)))
    for i, c in enumerate(letters, 1):
        best = np.minimum(row[:, 1:] + 1, row[:, :-1] + (others != c))
        whole = np.concatenate([np.full((len(others), 1), i), best], axis=1)
        row = np.minimum.accumulate(whole - step, axis=1) + step  # insertions come along the row
    return row[:, -1]


def distance(a: str, b: str) -> int:
    """Levenshtein distance with unit costs; case doesn't matter."""
    return int(distances(a, np.frombuffer(b.lower().encode("latin-1", "replace"), np.uint8)[None, :])[0])


def unknown(seq: str) -> int:
    return sum(c in "n." for c in seq.lower())


def poly_a(seq: str) -> int:
    """Length of the poly-A tail.

    The tail is looked at in stretches of 10, 15, 20, … letters from the end. The number of A and the
    number of other letters at the far edge both add up over the stretches; the tail grows as long as
    the A reach 0.8 of the stretch and no more than three edge letters were others.
    """
    if not seq:
        return 0
    tail = [c == "a" for c in seq.lower()[::-1]]
    last = len(tail) - 1
    tail = tail * (16 // len(tail) + 2) if last < 16 else tail + tail[:16]  # a look beyond the front goes on at the end
    found = list(accumulate(tail))

    def edge(n: int) -> int:
        return next((k for k in range(5) if tail[n - k]), 5)

    size, count = 10, found[10]
    if count / size < 0.8:
        return 0
    other = edge(size)
    while count / size >= 0.8 and other <= 3 and size < last:
        size += 5
        count += found[size]
        other += edge(size)
    length = size - other + 1
    return length if length >= 5 else 0


@F.pandas_udf(T.IntegerType())
def poly_a_length(seq: pd.Series) -> pd.Series:
    """poly_a of each sequence; 0 for null."""
    return seq.map(lambda s: poly_a(s or ""))


@dataclass(frozen=True)
class Trimmer:
    """Adapters and limits; `compat` keeps the cut and trim offsets of the older tool."""

    adapter3: str
    adapter5: str
    error: float = 0.1
    least: int = 300
    compat: bool = True

    @cached_property
    def rc3(self) -> str:
        return revcomp(self.adapter3)

    @cached_property
    def anchors(self) -> dict[int, str]:
        """Every third 6-mer of the reverse-complemented 3' adapter that occurs once among them."""
        grams = {i: self.rc3[i : i + KMER] for i in range(0, len(self.rc3) - KMER + 1, 3)}
        all_ = list(grams.values())
        return {i: g for i, g in grams.items() if all_.count(g) == 1}

    def hits(self, seq: str) -> list[tuple[int, int]]:
        """(found, anchor) of adapter copies, by place; anchors on nearly one diagonal are one copy."""
        kept: list[list[int]] = []
        near: dict[int, int] = {}  # kept copies lie more than KMER diagonals apart: one at most for each stretch of them
        for anchor, gram in sorted(self.anchors.items()):
            at = seq.find(gram)
            while at >= 0:
                line = at - anchor
                cell = line // (KMER + 1)
                same = min((k for c in (cell - 1, cell, cell + 1) if (k := near.get(c)) is not None and abs(line - (kept[k][0] - kept[k][1])) <= KMER), default=None)
                if same is None:
                    near[cell] = len(kept)
                    kept.append([at, anchor, 1])
                else:
                    kept[same][2] += 1
                at = seq.find(gram, at + 1)
        return [(f, a) for f, a, _ in sorted(kept, key=lambda h: (h[0], h[1], -h[2]))]

    def cuts(self, seqs: list[str]) -> list[list[int]]:
        """Begins of verified adapter copies in each sequence, by place; windows of all sequences are compared at once."""
        size = len(self.adapter3)
        starts = [[max(0, found - anchor) for found, anchor in self.hits(s)] for s in seqs]
        whole = [(k, x) for k, xs in enumerate(starts) for x in xs if x + size <= len(seqs[k])]
        codes = [np.frombuffer(s.lower().encode("latin-1", "replace"), np.uint8) if xs else None for s, xs in zip(seqs, starts)]
        far = distances(self.rc3, np.stack([codes[k][x : x + size] for k, x in whole])).tolist() if whole else []
        known = dict(zip(whole, far))

        def fits(k: int, start: int) -> bool:
            window = seqs[k][start : start + size]
            far = known[k, start] if (k, start) in known else distance(window, self.rc3[: len(window)])
            return (far - unknown(window)) / len(window) < self.error

        return [[x for x in xs if fits(k, x)] for k, xs in enumerate(starts)]

    def parts(self, seq: str, cuts: list[int]) -> list[tuple[str, int]]:
        """(segment, cut) between adapter copies; the rest has cut 0."""
        size, at, out = len(self.adapter3), 0, []
        for start in cuts:
            if at >= len(seq):
                break
            stop = start - at
            out.append((seq[at : at + stop] if stop >= 0 else seq[at : len(seq) + stop], 1))
            at = at + start + size if self.compat else start + size
        if at < len(seq):
            out.append((seq[at:], 0))
        return out

    def segments(self, seq: str) -> list[tuple[str, int]]:
        return self.parts(seq, self.cuts([seq])[0])

    def primers(self, seqs: list[str], primer: str, from_end: bool = False) -> list[int | None]:
        """For each sequence the offset 0..100 of the first best match within the error rate; all windows at once."""
        n = len(primer)
        counts = [max(0, min(101, len(s) - n + 1)) for s in seqs]
        windows = []
        for s, count in zip(seqs, counts):
            if count:
                near = s[len(s) - n - count + 1 :] if from_end else s[: count + n - 1]
                all_ = np.lib.stride_tricks.sliding_window_view(np.frombuffer(near.lower().encode("latin-1", "replace"), np.uint8), n)
                windows.append(all_[::-1] if from_end else all_)
        if not windows:
            return [None] * len(seqs)
        rates = distances(primer, np.concatenate(windows)) / n
        ends = np.cumsum(counts).tolist()
        own = [rates[z - c : z] for c, z in zip(counts, ends)]
        return [int(r.argmin()) if len(r) and r.min() < self.error else None for r in own]

    def primer(self, seq: str, primer: str, from_end: bool = False) -> int | None:
        return self.primers([seq], primer, from_end)[0]

    def classify_all(self, parts: list[tuple[str, int]]) -> list[tuple[str, str, int]]:
        """(trimmed, code, poly-A length) of each (segment, cut).

        The code says what was found at the 5' end (p primer, u none), the tail (A or T for the strand
        that was read, t or a without one) and the 3' end (p adapter, u none).
        """
        tails = [poly_a(seq) for seq, _ in parts]
        front = [seq[:-tail] if tail else revcomp(seq) for (seq, _), tail in zip(parts, tails)]
        found = self.primers([f for f, t in zip(front, tails) if t], self.adapter5)
        backs = self.primers([f for f, t in zip(front, tails) if not t], self.rc3, from_end=True)
        found, backs, out = iter(found), iter(backs), []
        for (_, cut), tail, body in zip(parts, tails, front):
            if tail:
                at = next(found)
                out.append((body, "uNAp", tail) if at is None else (body[at + len(self.adapter5) :], "pNAp", tail))
                continue
            at, end = next(backs), "p" if cut else "u"
            if at is None:
                tail = poly_a(body)
                out.append((body[:-tail], f"uTN{end}", tail) if tail else (body, f"utN{end}", 0))
                continue
            body = body[: max(0, len(body) - at - len(self.adapter5 if self.compat else self.adapter3))]
            tail = poly_a(body)
            out.append((body[:-tail], f"pTN{end}", tail) if tail else (revcomp(body), "pNAu" if cut else "pNau", 0))
        return out

    def classify(self, seq: str, cut: int) -> tuple[str, str, int]:
        return self.classify_all([(seq, cut)])[0]

    def reads(self, rows: list[tuple[str, str]]) -> list[tuple[str, str, str | None, int | None, str]]:
        """(id, seq, code, poly_a, status) of all segments of all (id, seq): kept, or discarded for their length."""
        cuts = iter(self.cuts([s for _, s in rows if len(s) >= self.least]))
        parts = [[(i, *p) for i, p in enumerate(self.parts(s, next(cuts)))] if len(s) >= self.least else None for _, s in rows]
        told = iter(self.classify_all([(p, cut) for own in parts if own for _, p, cut in own if len(p) >= self.least]))
        out: list[tuple[str, str, str | None, int | None, str]] = []
        for (id_, seq), own in zip(rows, parts):
            if own is None:
                out.append((id_, seq, None, None, "discard"))
                continue
            for i, part, _ in own:
                if len(part) < self.least:
                    out.append((f"{id_}___{i}", part, None, None, "discard"))
                    continue
                body, code, tail = next(told)
                out.append((f"{id_}_SUB{i}_{code}_{tail}", body, code, tail, "kept" if len(body) > self.least else "discard"))
        return out

    def read(self, id_: str, seq: str) -> list[tuple[str, str, str | None, int | None, str]]:
        return self.reads([(id_, seq)])


#: Reads whose windows are compared at once.
PIECE = 256


def trim_reads(reads: DataFrame, trimmer: Trimmer) -> DataFrame:
    """id, seq, code, poly_a, status for every segment of `reads(id, seq)`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            given = [(i, s or "") for i, s in zip(b["id"], b["seq"])]
            for at in range(0, max(1, len(given)), PIECE):
                rows = trimmer.reads(given[at : at + PIECE])
                yield pd.DataFrame(rows, columns=["id", "seq", "code", "poly_a", "status"]).astype({"poly_a": "Int32"})

    return reads.select("id", "seq").mapInPandas(run, "id string, seq string, code string, poly_a int, status string")
