"""Local alignment of short reads to long ones: seeds meet in a join, a banded kernel aligns them.

Scores: match 2, mismatch -6, a gap of n columns -(3 + 3n), soft clips free. A hit needs a score of
20 + 8 ln(read length).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoweave.functions.seq import revcomp

MATCH, MISMATCH, OPEN, EXTEND = 2, -6, 3, 3
BATCH = 256
#: Cells of the direction table of one batch, one byte each.
CELLS = 1 << 25
SEED = 20
#: Fixed parts of a seed: a seed with one mismatch agrees in two of three.
PARTS = ((0, 7), (7, 14), (14, 20))
#: Frequent seeds are given to all tasks up to this number; beyond, they are joined by shuffles.
FREQUENT_ROWS = 1_000_000
STOP, DIAGONAL, INSERTION, DELETION, OPEN_INSERTION, OPEN_DELETION = 0, 1, 2, 3, 4, 8


def align_batch(reads: list[str], windows: list[str], low: int | None = None, width: int | None = None) -> list[tuple[int, int, str, str]]:
    """(score, start in the window, CIGAR, MD) of the best local alignment of each pair inside a band.

    Read base i meets window bases i + low to i + low + width - 1; without a band, all. All pairs go
    through the band together, one read base at a time: two rows of scores are held, and one byte for
    each cell says which step explains it. Ties: the first read base, then window base, to end at; a
    pair of bases before an insertion before a deletion; the shortest gap.
    """
    rows, cols = max(map(len, reads), default=0), max(map(len, windows), default=0)
    if low is None or width is None:
        low, width = -rows, rows + cols + 1
    n, reach = len(reads), rows + width
    q, t = np.zeros((n, rows), np.uint8), np.zeros((n, reach), np.uint8)
    for k, (a, b) in enumerate(zip(reads, windows)):
        q[k, : len(a)] = np.frombuffer(a.encode("latin-1", "replace"), np.uint8)
        line = np.frombuffer(b.encode("latin-1", "replace"), np.uint8)[max(low, 0) :]
        begin = max(-low, 0)
        line = line[: max(reach - begin, 0)]
        t[k, begin : begin + len(line)] = line
    steps = np.zeros((rows, n, width), np.uint8)
    h = np.zeros((n, width), np.int32)
    none = np.int32(-(1 << 20))
    gap = np.full((n, width), none, np.int32)
    slope = EXTEND * np.arange(width, dtype=np.int32)
    best, at = np.zeros(n, np.int32), np.zeros((n, 2), np.int64)
    everyone = np.arange(n)
    edge = np.full((n, 1), none, np.int32)
    for i in range(rows):
        base, line = q[:, i : i + 1], t[:, i : i + width]
        fresh = np.hstack([h[:, 1:] - (OPEN + EXTEND), edge])
        longer = np.hstack([gap[:, 1:] - EXTEND, edge])
        gap = np.maximum(fresh, longer)
        diagonal = h + np.where(base == line, np.int32(MATCH), np.int32(MISMATCH))
        before = np.maximum(np.maximum(diagonal, gap), 0)
        before[(line == 0) | (base == 0)] = 0
        along = np.full((n, width), none, np.int32)
        along[:, 1:] = (np.maximum.accumulate(before + slope, axis=1) - slope)[:, :-1] - (OPEN + EXTEND)
        h = np.maximum(before, along)
        h[(line == 0) | (base == 0)] = 0
        step = np.where(h == diagonal, DIAGONAL, np.where(h == gap, INSERTION, DELETION)).astype(np.uint8)
        step[h == 0] = STOP
        step |= np.where(fresh >= longer, OPEN_INSERTION, 0).astype(np.uint8)
        step[:, 1:] |= np.where(along[:, 1:] == h[:, :-1] - (OPEN + EXTEND), OPEN_DELETION, 0).astype(np.uint8)
        steps[i] = step
        top = h.argmax(axis=1)
        more = h[everyone, top] > best
        best[more] = h[everyone, top][more]
        at[more, 0], at[more, 1] = i, top[more]
    paths, begins = way_back(steps, best, at)
    return [(int(s), *told(a, b, path, int(i), int(i + c + low))) for s, a, b, path, (i, c) in zip(best, reads, windows, paths, begins)]


def way_back(steps: np.ndarray, best: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Columns of each alignment, and the read base and band column of its first one; all pairs go back together."""
    n = len(best)
    i, c = at[:, 0].copy(), at[:, 1].copy()
    state = np.full(n, DIAGONAL)
    columns: list[np.ndarray] = []
    going = best > 0
    everyone = np.arange(n)
    inside = np.zeros(n, np.int64)  # 0, or the kind of the gap that is being followed back
    while going.any():
        code = np.where(going & (i >= 0) & (c < steps.shape[2]), steps[np.maximum(i, 0), everyone, np.minimum(c, steps.shape[2] - 1)], STOP)
        kind = code & 3
        going &= (inside > 0) | ((kind != STOP) & (i >= 0))
        state = np.where(inside > 0, inside, kind)
        columns.append(np.where(going, state, 0).astype(np.uint8))
        insert, delete = going & (state == INSERTION), going & (state == DELETION)
        inside = np.where(insert & ((code & OPEN_INSERTION) == 0), INSERTION, np.where(delete & ((code & OPEN_DELETION) == 0), DELETION, 0))
        pair = going & (state == DIAGONAL)
        i = i - (pair | insert)
        c = c + insert - delete
    letters = np.array(["", "M", "I", "D"])
    table = np.stack(columns[::-1]) if columns else np.zeros((0, n), np.uint8)
    return ["".join(letters[col[col > 0]]) for col in table.T], np.stack([i + 1, c], axis=1)


def told(read: str, window: str, path: str, first: int, start: int) -> tuple[int, str, str]:
    """Start, CIGAR with soft clips, and MD of a path that begins at read base `first` and window base `start`."""
    used = first + sum(op != "D" for op in path)
    ops = "S" * first + path + "S" * (len(read) - used)
    cigar = "".join(f"{sum(1 for _ in group)}{op}" for op, group in groupby(ops))
    md, run, x, y = [], 0, first, start
    for op, group in groupby(path):
        size = sum(1 for _ in group)
        if op == "M":
            for a, b in zip(read[x : x + size], window[y : y + size]):
                if a == b:
                    run += 1
                else:
                    md.append(f"{run}{b}")
                    run = 0
        elif op == "D":
            md.append(f"{run}^{window[y : y + size]}")
            run = 0
        x, y = x + size * (op != "D"), y + size * (op != "I")
    return start, cigar, "".join(md) + str(run)


def seed_codes(seq: str) -> np.ndarray:
    """Two bits for each base of the seed at every place; -1 where a base is none of ACGT."""
    table = np.full(256, 255, np.uint8)
    for k, letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
        for x in letters:
            table[ord(x)] = k
    base = table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    count = max(len(base) - SEED + 1, 0)
    code = np.zeros(count, np.int64)
    for k in range(SEED):
        code = (code << 2) | (base[k : k + count] & 3)
    bad = np.r_[0, np.cumsum(base == 255)]
    code[bad[SEED : SEED + count] > bad[:count]] = -1
    return code


def part_mask(part: tuple[int, int]) -> int:
    return ((1 << 2 * (part[1] - part[0])) - 1) << 2 * (SEED - part[1])


MASKS = [part_mask(p) for p in PARTS]


def seeds(seqs: DataFrame, keep: list[str], step: Column) -> DataFrame:
    """`keep` columns, place, code and three keys for each seed of `seqs(seq)` that begins at a multiple of `step`.

    A key is what two of the three parts of a seed have, so seeds with one mismatch share one and
    equal seeds all three.
    """
    rows = seqs.select(*keep, F.col("seq"), step.cast("int").alias("_step"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                code = seed_codes(b.column(len(keep))[k].as_py() or "")
                place = np.arange(0, len(code), max(1, b.column(len(keep) + 1)[k].as_py() or 1))
                place = place[code[place] >= 0]
                for first in range(0, len(place), 1 << 16):
                    part = place[first : first + (1 << 16)]
                    key = np.concatenate([(code[part] & ~mask) << 2 | j for j, mask in enumerate(MASKS)])
                    own = b.slice(k, 1).select(keep).take(pa.array(np.zeros(len(key), np.int64)))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.tile(part, 3), pa.int32()), pa.array(np.tile(code[part], 3), pa.int64()), pa.array(key, pa.int64())], [*keep, "place", "code", "key"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", place int, code long, key long")


def candidates(reads: DataFrame, refs: DataFrame, band: int, hits: int) -> DataFrame:
    """id, flag, ref, bin and n (seeds) of the places where each of `reads(id, flag, seq)` may lie on `refs(ref, seq)`.

    Seeds of 20 bases with one mismatch, 1 + sqrt(length) / 2 apart. Of neighbouring bins of `band`
    diagonals those with most different seeds count, so a place where all seeds fit always does. A read keeps `hits` places, those with most seeds first. A seed
    that lies in more than `hits` places of the references is dealt over groups of about as many; a
    read looks into one group, by its id, so that all long reads are met by some reads.
    """
    q = seeds(reads, ["id", "flag"], F.floor(1 + 0.5 * F.sqrt(F.length("seq")))).withColumnsRenamed({"place": "q_at", "code": "q_code"})
    t = seeds(refs, ["ref"], F.lit(1)).withColumnsRenamed({"place": "t_at", "code": "t_code"})
    frequent = t.groupBy("key").count().where(F.col("count") > hits).select("key", F.ceil(F.col("count") / hits).cast("int").alias("groups"))
    if frequent.count() <= FREQUENT_ROWS:
        frequent = F.broadcast(frequent)
    deal = lambda rows, by: rows.join(frequent, "key", "left").withColumn("group", F.pmod(F.xxhash64(by), F.coalesce("groups", F.lit(1)))).drop("groups")
    met = deal(q, "id").join(deal(t, "ref"), ["key", "group"])
    x = F.col("q_code").bitwiseXOR(F.col("t_code"))
    differ = F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(int("01" * SEED, 2))))
    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in MASKS]), F.col("key").bitwiseAND(F.lit(3)).cast("int") + 1)
    # equal seeds meet at all three keys and count at the first; others meet where the part with the mismatch is left out
    met = met.where((differ <= 1) & ((F.col("key").bitwiseAND(F.lit(3)) == 0) | (x.bitwiseAND(mask) != 0)))
    counted = met.groupBy("id", "flag", "ref", F.floor((F.col("t_at") - F.col("q_at")) / band).cast("int").alias("bin")).agg(F.count_distinct("q_at").alias("n"))
    line = W.partitionBy("id", "flag", "ref").orderBy("bin")
    beside = lambda f, d: F.when(f("bin").over(line) == F.col("bin") + d, f("n").over(line)).otherwise(0)
    tops = counted.withColumn("_l", beside(F.lag, -1)).withColumn("_r", beside(F.lead, 1)).where("_l <= n and _r <= n").drop("_l", "_r")
    order = W.partitionBy("id").orderBy(F.desc("n"), F.xxhash64("id", "ref"), "ref", "flag", "bin")
    return tops.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= hits).drop("_k")


def apart(found: list[tuple[int, int, str, str]]) -> list[int]:
    """Numbers of the alignments of one read on one long read that are no parts of better ones.

    An alignment goes if one with a higher score, or an earlier one, begins or ends on the same
    diagonal and overlaps it on both reads.
    """
    spans = []
    for score, start, cigar, _ in found:
        ops = [(int(n), op) for n, op in _cigar(cigar)]
        a = ops[0][0] if ops and ops[0][1] == "S" else 0
        r = sum(n for n, op in ops if op in "MI")
        w = sum(n for n, op in ops if op in "MD")
        spans.append((a, a + r, start, start + w))
    kept: list[int] = []
    for k in sorted(range(len(found)), key=lambda k: (-found[k][0], k)):
        a, b, s, e = spans[k]
        if not any(a < y and x < b and s < v and u < e and (s - a == u - x or e - b == v - y) for x, y, u, v in (spans[j] for j in kept)):
            kept.append(k)
    return sorted(kept)


def _cigar(cigar: str) -> Iterator[tuple[str, str]]:
    number = ""
    for c in cigar:
        if c.isdigit():
            number += c
        else:
            yield number, c
            number = ""


def align_reads(reads: DataFrame, refs: DataFrame, band: int = 32, hits: int = 5000) -> DataFrame:
    """SAM columns, score and weight for the hits of each of `reads(id, seq, weight)` on each of `refs(id, seq)`.

    Both strands are tried. A read has as many hits on a long read as it has places there, and `hits`
    in all. Ids must be distinct; null sequences have no hit; seeds with letters other than ACGT are no
    seeds.
    """
    both = F.array(F.struct(F.lit(0).alias("flag"), F.col("seq").alias("s")), F.struct(F.lit(16).alias("flag"), revcomp(F.col("seq")).alias("s")))
    r = reads.select("id", "weight", F.explode(both).alias("x")).select("id", "weight", "x.flag", F.col("x.s").alias("seq"))
    long_reads = refs.select(F.col("id").alias("ref"), "seq")
    places = candidates(r.select("id", "flag", "seq"), long_reads, band, hits).groupBy("id", "flag", "ref").agg(F.sort_array(F.collect_list("bin")).alias("bins"))
    pairs = places.join(r, ["id", "flag"]).join(long_reads.select("ref", F.col("seq").alias("long")), "ref")
    # the band reaches one bin beyond the seeds' on both sides; a window may begin before the long read
    begin = lambda b: (b - 1) * band
    cut = lambda b: F.substr("long", F.greatest(begin(b), F.lit(0)) + 1, F.length("seq") + 3 * band + F.least(begin(b), F.lit(0)))
    pairs = pairs.select("id", "ref", "flag", "weight", "seq", F.transform("bins", begin).alias("starts"), F.transform("bins", cut).alias("windows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            flat = [(k, s, w) for k, (starts, windows) in enumerate(zip(b["starts"], b["windows"])) for s, w in zip(starts, windows)]
            seqs = b["seq"].tolist()
            flat.sort(key=lambda f: len(seqs[f[0]]))
            got: dict[int, list[tuple[int, int, str, str]]] = {}
            at = 0
            while at < len(flat):
                size = max(1, min(BATCH, CELLS // (3 * band * max(1, len(seqs[flat[min(at + BATCH, len(flat)) - 1][0]])))))
                part = flat[at : at + size]
                at += size
                padded = [" " * max(0, -s) + w for _, s, w in part]
                for (k, s, _), (score, start, cigar, md) in zip(part, align_batch([seqs[k] for k, _, _ in part], padded, 0, 3 * band)):
                    if score >= 20 + 8 * math.log(max(1, len(seqs[k]))):
                        got.setdefault(k, []).append((score, s + start, cigar, md))
            rows = [(k, *found[j]) for k, found in sorted(got.items()) for j in apart(found)]
            o = b.iloc[[x[0] for x in rows]]
            yield pd.DataFrame({"qname": o["id"], "flag": o["flag"], "rname": o["ref"], "pos": [x[2] + 1 for x in rows], "cigar": [x[3] for x in rows], "seq": o["seq"], "md": [x[4] for x in rows], "score": [x[1] for x in rows], "weight": o["weight"]})

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.mapInPandas(run, f"qname {kind['id']}, flag int, rname {kind['ref']}, pos int, cigar string, seq string, md string, score int, weight double")


class Hasher:
    """64-bit hashes of all strings of `k` bytes in a text: a difference of two running sums each."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, k: int) -> None:
        self.k = k
        self.powers = self.inverse = np.ones(1, np.uint64)

    def __call__(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if n < self.k:
            return np.zeros(0, np.uint64)
        if len(self.powers) < n:
            size = 2 * n
            lines = (np.full(size, b, np.uint64) for b in (self.BASE, pow(self.BASE, -1, 1 << 64)))
            self.powers, self.inverse = (np.multiply.accumulate(np.r_[np.ones(1, np.uint64), line]) for line in lines)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.powers[:n])]
        h = (sums[self.k :] - sums[: n - self.k + 1]) * self.inverse[: n - self.k + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def least_places(codes: np.ndarray, width: int, block: int = 1 << 20) -> np.ndarray:
    """Places that hold the least code, the first of equal ones, of some `width` neighbouring places.

    Codes are compared by their upper 43 bits; the lower ones hold places of a block, so that the
    minimum over a sliding window says where it lies.
    """
    found = []
    for first in range(0, len(codes) - width + 1, block):
        part = codes[first : first + block + width - 1]
        x = (part >> np.uint64(21) << np.uint64(21)) | np.arange(len(part), dtype=np.uint64)
        rows = np.full(-(-len(x) // width) * width, ~np.uint64(0), np.uint64)
        rows[: len(x)] = x
        rows = rows.reshape(-1, width)
        ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[: len(x) - width + 1]
        behind = np.minimum.accumulate(rows, axis=1).ravel()[width - 1 : len(x)]
        found.append(np.unique(np.minimum(ahead, behind) & np.uint64((1 << 21) - 1)).astype(np.int64) + first)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def anchors(seqs: DataFrame, keep: str, k: int, width: int, whole: bool) -> DataFrame:
    """`keep`, place and key of the strings of `k` bytes of `seqs(keep, _text)` that stand for the windows of `width` such strings.

    Equal windows have equal anchors at equal places. With `whole` all windows are taken, else the first.
    """
    kind = dict(seqs.dtypes)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(k)
        for b in batches:
            rows, places, keys = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                line = np.frombuffer(text or b"", np.uint8)
                codes = hashed(line if whole else line[: k + width - 1])
                at = least_places(codes, width)
                rows.append(np.full(len(at), i))
                places.append(at)
                keys.append(codes[at].view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places)), pa.array(np.concatenate(keys))], [keep, "place", "key"])

    return seqs.select(keep, "_text").mapInArrow(run, f"{keep} {kind}, place long, key long")


def whole_hits(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """qname, rname, flag of the long reads of `refs(id, seq)` that hold one of `reads(id, seq)`, or its reverse complement, whole.

    Those are the hits of align_reads() in which all bases agree, without a limit to their number. One
    string of each window of a long read, and of each short read, is its anchor; places where both are
    equal are cut out and joined by their text. What is joined grows with the sequences and
    with what is found. Ids must be distinct.
    """
    both = F.array(F.struct(F.lit(0).alias("flag"), F.col("seq").alias("s")), F.struct(F.lit(16).alias("flag"), revcomp(F.col("seq")).alias("s")))
    size = F.octet_length("seq")
    # shorter ones don't reach the score of a hit
    strands = reads.where(MATCH * F.length("seq") >= 20 + 8 * F.log(F.length("seq"))).select(F.col("id").alias("qname"), F.explode(both).alias("x")).select("qname", "x.flag", F.col("x.s").alias("seq"))
    span = strands.agg(F.min(size)).first()[0] or SEED
    k = max(SEED, span // 2)
    width = span - k + 1
    asked = anchors(strands.select("seq").distinct().withColumn("_text", F.col("seq").cast("binary")), "seq", k, width, whole=False)
    asked = asked.select("key", F.col("place").alias("_at"), size.alias("_n")).distinct()
    long_reads = refs.select(F.col("id").alias("rname"), F.col("seq").cast("binary").alias("_text"))
    places = anchors(long_reads, "rname", k, width, whole=True).join(asked, "key").select("rname", (F.col("place") - F.col("_at")).cast("int").alias("_at"), "_n").where("_at >= 0")
    cut = F.substr("_text", F.col("_at") + 1, F.col("_n"))
    windows = places.join(long_reads, "rname").select("rname", cut.alias("_cut"), "_n").where("length(_cut) = _n").select("rname", F.col("_cut").cast("string").alias("seq")).distinct()
    return windows.join(strands, "seq").select("qname", "rname", "flag")
