"""Operator 8: removal of long repeated byte strings by merging shard suffix orders.

Content-chosen anchors (window minima of hashed grams) cut the suffixes down to those that can be
part of a repeat: two equal strings of `length` bytes have the same anchor at the same place. Every
shard of documents orders the suffixes at its anchors that occur again and sends them in that order,
each with the bytes that precede it: a Burrows-Wheeler transform of the anchored suffixes, with
`length` - GRAM preceding bytes in place of one. Where shards meet, the orders are merged as such
transforms are: the interleave, at first shard after shard, is refined one symbol at a time by a
stable pass that keeps each shard's order, and the round that parts two neighbours is their common
prefix. Reading the preceding bytes one by one refines the same intervals to the left. An interval
whose left and right reach add up to `length` is a repeated string; all its members but the earliest
are removed. Transforms of whole shards would take `length` rounds over every byte of the corpus;
the anchors leave about one suffix in 37 bytes, and only those whose gram repeats.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import lists, mix64, staged, utf8, work_dir

GRAM = 28
PIECE = 1 << 18
SPOOL = 1_000_000
OFTEN = 16  # counts below are left out: a hot gram has this many in nearly every task
HOT = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTES = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the k bytes at each place (the last axis), put together from powers of two."""
    h, size, out, have = BYTES[b], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, have = h, size
            else:
                n = h.shape[-1] - have
                out = h[..., :n] * _power(have) + out[..., size : size + n] if n > 0 else h[..., :0]
                have += size
        size *= 2
        if size > k:
            break
        h = h[..., : -(size // 2)] * _power(size // 2) + h[..., size // 2 :]
    return mix64(out[..., : max(0, b.shape[-1] - k + 1)]) | np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def _slide(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of w values."""
    size, n = 1, len(x)
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return pick(x[: n - w + 1], x[rest : rest + n - w + 1])


def anchors(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in joined texts; `ends` has for each byte its text's end."""
    w = length - GRAM + 1
    if len(b) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(b)
    low = _slide(h, w, np.minimum)
    low[np.arange(len(low)) + length > ends[: len(low)]] = 0  # the string would cross into the next text
    high = _slide(np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero(h == high[: len(h)])
    return at, h[at]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, from byte, to byte): short texts together, long ones in overlapping parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > PIECE:
            for s in range(offsets[i], offsets[i + 1], PIECE):
                yield i, i + 1, s, min(offsets[i + 1], s + PIECE + length - 1)
            i += 1
            continue
        j = max(i + 1, min(n, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1))
        yield i, j, offsets[i], offsets[j]
        i = j


def _repeated_anchors(texts: DataFrame, length: int, parts: int) -> DataFrame:
    """doc, at: the anchors of `texts(doc, text)` whose gram occurs more than once; and hot, times: how
    often grams occur that are frequent in some task (doc and at are null there).

    A task sends each gram once, with a mark if it has met it again itself, so that no gram has
    more rows than there are tasks.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = ["part", "grams", "docs", "places", "times"]

        def flush() -> Iterator[pa.RecordBatch]:
            if not any(len(h) for h, _, _ in held):
                return
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, doc, at = h[order], doc[order], at[order]
            new = np.r_[True, h[1:] != h[:-1]]
            again = ~new | np.r_[h[1:] == h[:-1], False]
            known = np.flatnonzero(again)
            rows = [[], [], [], [], []]
            for k in range(0, len(known), 1 << 14):
                x = known[k : k + (1 << 14)]
                for r, v in zip(rows, (int(h[x[0]] % np.uint64(1 << 30)), None, doc[x].tobytes(), at[x].tobytes(), None)):
                    r.append(v)
            one = np.flatnonzero(new)
            times = np.diff(np.r_[one, len(h)])
            place = np.where(again[one], -1 - at[one], at[one])  # a negative place: known already
            part = (h[one] >> np.uint64(20)) % np.uint64(4 * parts)
            order = np.argsort(part, kind="stable")
            one, place, part, times = one[order], place[order], part[order], times[order]
            cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)] if len(part) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                often = np.flatnonzero(times[a:b] >= OFTEN)
                counted = np.stack([h[one[a:b]][often].astype(np.int64), times[a:b][often]]).tobytes() if len(often) else None
                for r, v in zip(rows, (int(part[a]), h[one[a:b]].tobytes(), doc[one[a:b]].tobytes(), place[a:b].tobytes(), counted)):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names)

        size = 0
        for batch in batches:
            docs = np.asarray(batch.column(0))
            offsets, data = _bytes_of(batch.column(1))
            for i, j, s, e in _pieces(offsets, length):
                ends = np.repeat(np.minimum(offsets[i + 1 : j + 1], e), np.minimum(offsets[i + 1 : j + 1], e) - np.maximum(offsets[i:j], s)) - s
                at, h = anchors(data[s:e], ends, length)
                of = np.searchsorted(offsets[i : j + 1], at + s, side="right") - 1 + i
                held.append((h, docs[of], at + s - offsets[of]))
                size += len(at)
                if size > SPOOL:
                    yield from flush()
                    size = 0
        yield from flush()

    kinds = [("doc", pa.int64()), ("at", pa.int64()), ("hot", pa.int64()), ("times", pa.int64())]

    def out(doc: np.ndarray | None, at: np.ndarray | None, hot: np.ndarray | None = None, times: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(doc) if doc is not None else len(hot)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else pa.array(x, t) for x, (_, t) in zip((doc, at, hot, times), kinds)], [k for k, _ in kinds])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for _, grams, docs, places, times in zip(*(c.to_pylist() for c in batch.columns)):
                doc, at = np.frombuffer(docs, np.int64), np.frombuffer(places, np.int64)
                if times is not None:
                    yield out(None, None, *np.frombuffer(times, np.int64).reshape(2, -1))
                if grams is None:
                    yield out(doc, at)
                else:
                    held.append((np.frombuffer(grams, np.uint64), doc, at))
        if held:
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h)
            h, doc, at = h[order], doc[order], at[order]
            same = h[1:] == h[:-1]
            hit = (np.r_[False, same] | np.r_[same, False]) & (at >= 0)
            yield out(doc[hit], at[hit])

    sent = texts.select("doc", "text").mapInArrow(shard, "part long, grams binary, docs binary, places binary, times binary")
    return sent.repartition(parts, "part").mapInArrow(meet, "doc long, at long, hot long, times long")


def _anchored(batch: pa.RecordBatch, side: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash of the gram, context, doc, at, bytes on the left, bytes on the right) for the anchors of
    (doc, text, places), some 16 000 at a time."""
    offsets, data = _bytes_of(batch.column(1))
    sizes, places = lists(batch.column(2))
    of = np.repeat(np.arange(batch.num_rows), np.diff(sizes))
    if not len(of):
        return
    doc, at = np.asarray(batch.column(0))[of], places.astype(np.int64)
    left = np.minimum(at, side)
    right = np.minimum(offsets[of + 1] - offsets[of] - at - GRAM, side)
    step = np.arange(-side, side + GRAM)
    for k in range(0, len(of), 1 << 14):
        cut = slice(k, k + (1 << 14))
        l, r = left[cut], right[cut]
        ctx = np.zeros((len(l), len(step) + 2), dtype=np.uint8)
        ctx[:, -2], ctx[:, -1] = l, r
        begin = offsets[of[cut]] + at[cut]
        for i in range(0, len(l), 2048):
            x = slice(i, i + 2048)
            inside = (step >= -l[x, None]) & (step < GRAM + r[x, None])
            ctx[x, :-2] = np.where(inside, data[np.where(inside, begin[x, None] + step, offsets[0])], 0)
        yield gram_hashes(ctx[:, side : side + GRAM])[:, 0].astype(np.int64), ctx, doc[cut], at[cut], l, r


def _hot_repeats(placed: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """doc, s, e: repeated strings around the anchors of the `hot` grams, found by the strings themselves.

    A gram that very many suffixes share is not merged in one task: every string of `length` bytes
    around it is a key of its own, by two 64-bit hashes, and the earliest start of each is a minimum
    that is taken in the shards first.
    """
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                for h, ctx, doc, at, l, r in _anchored(whole.slice(start, 512), side):
                    x = np.flatnonzero(np.isin(h, hot))
                    for i in range(0, len(x), 2048):
                        y = x[i : i + 2048]
                        body = ctx[y, :-2]
                        before = side - np.arange(body.shape[1] - length + 1)  # bytes in front of the gram
                        row, col = np.nonzero((before <= l[y, None]) & (side - before <= r[y, None]))
                        one, two = gram_hashes(body, length), gram_hashes(body ^ np.uint8(0x5A), length)
                        keys = np.stack([one[row, col].astype(np.int64), two[row, col].astype(np.int64), doc[y][row], at[y][row] - before[col]], axis=1)
                        keys = keys[np.lexsort((keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0]))]
                        first = np.r_[True, (keys[1:, :2] != keys[:-1, :2]).any(axis=1)]
                        fresh = first | np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]  # one string has several anchors
                        keys, first = keys[fresh], first[fresh]
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in keys.T), pa.array(~first)], ["one", "two", "doc", "s", "later"])

    strings = placed.mapInArrow(run, "one long, two long, doc long, s long, later boolean")
    firsts = strings.where("not later").groupBy("one", "two").agg(F.min(F.struct("doc", "s")).alias("first"))
    again = strings.where("not later").join(firsts, ["one", "two"]).where(F.struct("doc", "s") != F.col("first"))
    return again.select("doc", "s").unionByName(strings.where("later").select("doc", "s")).withColumn("e", F.col("s") + length)


def _contexts(placed: DataFrame, length: int, hot: np.ndarray) -> DataFrame:
    """h, ctx, doc, at, shard, place for the anchors `places` of each (doc, text, places), without `hot` grams.

    ctx is the gram with up to length - GRAM bytes on either side, then how many there are on each.
    Rows of a shard (some 16 000 anchors of one task) come in the order of their suffixes, then of
    the bytes before, read backwards; place counts them. Of equal contexts in a shard the earliest
    goes on; the others (a short ctx, h spread) are repeats.
    """
    side = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, names = TaskContext.get().partitionId() << 32, ["h", "ctx", "doc", "at", "shard", "place"]
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                for h, ctx, d, a, l, r in _anchored(whole.slice(start, 512), side):
                    if len(hot):
                        own = ~np.isin(h, hot)
                        h, ctx, d, a, l, r = (x[own] for x in (h, ctx, d, a, l, r))
                    if not len(h):
                        continue
                    order = np.lexsort((a, d))
                    suffix_first = np.concatenate([ctx[:, side : side + length], ctx[:, side - 1 :: -1], ctx[:, -2:]], axis=1)
                    flat = np.ascontiguousarray(suffix_first[order]).view(f"V{ctx.shape[1]}")[:, 0]
                    _, first = np.unique(flat, return_index=True)
                    keep = order[first]  # the shard's suffix order
                    body = np.ascontiguousarray(ctx[keep])
                    column = pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer(np.arange(len(body) + 1, dtype=np.int32) * body.shape[1]), pa.py_buffer(body)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[keep]), column, pa.array(d[keep]), pa.array(a[keep]), pa.array(np.full(len(keep), shard)), pa.array(np.arange(len(keep), dtype=np.int32))], names)
                    shard += 1
                    rest = np.ones(len(d), dtype=bool)
                    rest[keep] = False
                    if rest.any():
                        reach = np.concatenate([l[rest, None], r[rest, None]], axis=1).astype(np.uint8)
                        short = pa.array([x.tobytes() for x in reach], pa.binary())
                        spread = mix64((d[rest] * 31 + a[rest]).astype(np.uint64)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(spread), short, pa.array(d[rest]), pa.array(a[rest]), pa.array(np.zeros(len(spread), np.int64)), pa.array(np.zeros(len(spread), np.int32))], names)

    return placed.mapInArrow(run, "h long, ctx binary, doc long, at long, shard long, place int")


def refine(block: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the rows of all shards: their order, the common prefix with the row before (-1 in
    another block), by refining the interleave with one column of `symbols` in each round.

    Rows come grouped by block, then shard after shard; a round deals each interval to its symbols and
    keeps the order of the rows of one symbol, which are runs already if shards are ordered. A row alone in its interval is left out of later rounds.
    """
    n, depth = symbols.shape
    order = np.arange(n)
    prefix = np.full(n, depth, dtype=np.int16)
    prefix[np.r_[True, block[1:] != block[:-1]]] = -1
    start = np.maximum.accumulate(np.where(prefix < depth, np.arange(n), 0))  # where each row's interval begins
    for d in range(depth):
        open_ = prefix == depth
        live = np.flatnonzero(open_ | np.r_[open_[1:], False])  # rows that share an interval with a neighbour
        if not len(live):
            break
        s = symbols[order[live], d].astype(np.int64)
        key = start[live] * 256 + s
        new = np.argsort(key, kind="stable")
        order[live] = order[live[new]]
        key = key[new]
        parted = np.r_[False, key[1:] != key[:-1]] & (prefix[live] == depth)
        prefix[live[parted]] = d
        start[live] = np.maximum.accumulate(np.where(prefix[live] < depth, live, start[live[0]]))
    return order, prefix, start


def _mark(h: np.ndarray, ctx: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For rows grouped by h: which strings, by bytes before the gram, also start earlier."""
    side = length - GRAM
    left, right = ctx[:, -2].astype(np.int64), ctx[:, -1].astype(np.int64)
    order, prefix, _ = refine(h, ctx[:, side + GRAM : side + GRAM + side])
    back = ctx[order, :side][:, ::-1]
    left, right, rank, block = left[order], right[order], rank[order], np.cumsum(prefix < 0) - 1
    out = np.zeros((len(h), side + 1), dtype=bool)
    live = np.arange(len(h))
    for a in range(side + 1):
        if a:
            # one byte further to the left parts the intervals; rows that stand alone are done
            key = block[live] * 256 + back[live, a - 1]
            _, at, count = np.unique(key, return_inverse=True, return_counts=True)
            block[live] = at
            live = live[(count[at] > 1) & (left[live] >= a)]
        if not len(live):
            break
        run = np.cumsum(prefix < side - a)
        fit = live[right[live] >= side - a]
        if not len(fit):
            continue
        key = block[fit] * (len(h) + 1) + run[fit]
        by = np.lexsort((rank[fit], key))
        key = key[by]
        later = np.r_[False, key[1:] == key[:-1]]
        out[order[fit[by[later]]], a] = True
    return out


def _ranges(doc: np.ndarray, at: np.ndarray, marked: np.ndarray, length: int) -> pa.RecordBatch:
    """Byte ranges covered by the marked strings of each row."""
    wide = np.zeros((len(doc), marked.shape[1] + 2), dtype=np.int8)
    wide[:, 1:-1] = marked
    edge = np.diff(wide, axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(at[row] - (last - 1)), pa.array(at[row] - first + length)], ["doc", "s", "e"])


def _repeats(contexts: DataFrame, length: int, parts: int) -> DataFrame:
    """doc, s, e: byte ranges that are covered by strings which also start earlier."""
    side = length - GRAM
    width = length + side + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            h, ctx, doc, at = cols
            return _ranges(doc, at, _mark(h, ctx, np.lexsort((at, doc)).argsort(), length), length)

        for batch in batches:
            h, doc, at = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            offsets, data = _bytes_of(batch.column(1))
            full = np.diff(offsets) == width
            if not full.all():
                x = np.flatnonzero(~full)
                reach = data[offsets[x][:, None] + [0, 1]].astype(np.int64)
                before = np.arange(side + 1)
                yield _ranges(doc[x], at[x], (before <= reach[:, :1]) & (side - before <= reach[:, 1:]), length)
            x = np.flatnonzero(full)
            if len(x):
                held.append([h[x], data[offsets[x][:, None] + np.arange(width)], doc[x], at[x]])
                size += len(x)
            if size > 30_000:
                cols = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last gram may go on
                if cut:
                    yield work([c[:cut] for c in cols])
                held, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if size:
            yield work([np.concatenate(c) for c in zip(*held)])

    return contexts.repartition(parts, "h").sortWithinPartitions("h", "shard", "place").mapInArrow(run, "doc long, s long, e long")


def _lowest(docs: DataFrame) -> DataFrame:
    """Adds doc: the id as a number; a null id comes before all others."""
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))


def _cut(docs: DataFrame, length: int, keep: tuple[str, ...], hot_rows: int, as_text: bool = False) -> tuple[DataFrame, bool]:
    """(doc, doc_id, the `keep` columns, n_bytes, spans and kept of each document, whether ids repeat).

    Texts are written once, in buckets by document, with all that the result carries: later steps read
    them there and no text is shuffled again.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _lowest(docs.select("doc_id", utf8("text").alias("text"), *keep))
    repeated = rows.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    if repeated:
        rows = rows.groupBy("doc").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), *[F.first(c).alias(c) for c in keep])
    same, size = F.sha2("text", 256), F.octet_length("text").cast("long")
    first = staged(rows.select("doc", same.alias("same")).groupBy("same").agg(F.min("doc").alias("doc")).select("doc"), "first-texts")
    name, path = f"texts_{uuid.uuid4().hex}", f"{work_dir(spark)}/texts-{uuid.uuid4().hex}"
    # a shuffle at every size: it also deals the rows to their buckets
    unique = rows.select("doc", "text", "doc_id", *keep).join(first.hint("merge"), "doc", "left_semi")
    unique.write.option("path", path).option("compression", "zstd").bucketBy(parts, "doc").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, the name isn't needed beyond this plan

    again = staged(_repeated_anchors(texts, length, parts), "repeated-anchors")
    total = again.where("doc is not null").count()
    limit = max(hot_rows, total // HOT)  # at most HOT grams are above it
    hot = np.array(sorted(r["hot"] for r in again.where("hot is not null").groupBy("hot").agg(F.sum("times").alias("n")).where(F.col("n") > limit).collect()), dtype=np.int64)
    places = again.where("doc is not null").select("doc", "at").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("at")).alias("places"))
    placed = texts.select("doc", "text").join(places, "doc").select("doc", "text", "places")
    found = _repeats(_contexts(placed, length, hot), length, parts)
    if len(hot):
        found = found.unionByName(_hot_repeats(placed, hot, length))
    ranges = found.distinct().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1024) for whole in batches for k in range(0, whole.num_rows, 1024)):
            spans, kept, sizes = [], [], []
            for text, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                merged: list[list[int]] = []
                for p in pieces or ():
                    if merged and p["s"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], p["e"])
                    else:
                        merged.append([p["s"], p["e"]])
                spans.append([{"start": s, "end": e} for s, e in merged])
                edges = [0, *(x for m in merged for x in m), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                sizes.append(len(text))
            spans_of = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sizes, pa.int64()), spans_of, pa.array(kept, pa.string() if as_text else pa.binary())], [*batch.schema.names[2:], "n_bytes", "spans", "kept"])

    carried, kind = texts.select("doc", "doc_id", *keep), "string" if as_text else "binary"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields)
    done = texts.join(ranges, "doc", "left").select("text", "ranges", *carried.columns).mapInArrow(cut, f"{kinds}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept {kind}")
    # of equal texts the first is in `done`; later ones go as a whole or are too short to
    long_enough = size >= length
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    slim = rows.select("doc", "doc_id", *keep, size.alias("n_bytes"), F.when(long_enough, whole).otherwise(none).alias("spans"), F.when(long_enough, F.lit(b"")).otherwise(F.col("text")).cast(kind).alias("kept"))
    others = slim.join(first.hint("merge"), "doc", "left_anti")
    return done.unionByName(others), repeated


def remove_repeats(docs: DataFrame, length: int = 100, keep: tuple[str, ...] = (), hot_rows: int = 50_000, as_text: bool = False) -> DataFrame:
    """doc_id, the `keep` columns, n_bytes, spans and kept (bytes) for each row of `docs(doc_id, text)`.

    Texts are UTF-8 bytes, a null text is empty. Every byte is removed that is covered by a string of
    `length` bytes (GRAM < length < 256) which also starts earlier: in a document with a smaller id,
    or further to the front. `spans` are the maximal removed ranges, kept the other bytes, joined;
    with `as_text` as a string, without the parts of a character that a cut left behind.

    Rows that repeat an id are one document; if their texts differ, it has the smallest. A null id
    comes before all others. Of equal texts the first stays, the others are removed as a whole if
    they have `length` bytes. Long texts are read whole, in overlapping parts. Grams that occur more
    than `hot_rows` times, and more often than one in HOT of all, are not merged in one task but split
    by the strings around them. Further columns are ignored; an empty table gives an empty one.
    """
    result, repeated = _cut(docs, length, keep, hot_rows, as_text)
    return _by_row(docs.select("doc_id", *keep), result.drop(*keep) if repeated else result, repeated).select("doc_id", *keep, "n_bytes", "spans", "kept")


def digests(docs: DataFrame, length: int = 100, hot_rows: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what remove_repeats() returns."""
    cut, repeated = _cut(docs, length, (), hot_rows)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    result = cut.select("doc", "doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return _by_row(docs.select("doc_id"), result, repeated).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _by_row(docs: DataFrame, result: DataFrame, repeated: bool) -> DataFrame:
    return _lowest(docs).join(result.drop("doc_id"), "doc") if repeated else result
