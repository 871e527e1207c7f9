"""Operator 12: hard negatives by an STR-packed R-tree.

Vectors are dealt into tiles by sort-tile-recursive packing: slabs of one coordinate, cells of a
second one. Each tile packs its rows the same way into leaves of one label and boxes of leaves. The
minimum bounding box of a node gives, coordinate by coordinate, an interval for the inner product
with an anchor. A best-first queue opens the most promising box first and prunes boxes whose interval
misses the score window or lies strictly below the k-th score so far.

Between tiles the search is best-first too: an anchor goes to its most promising tile first, and
with the k-th score from there to those of the others that its box can't rule out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoweave.llm.shared import lists, staged

#: Rows of a tile, when there are more of them than tiles by the number of shuffle partitions.
TILE_ROWS = 1 << 18
LEAF_ROWS = 256
FANOUT = 16
#: Anchors that share a queue.
BLOCK = 64
#: Boxes of tiles are given to all tasks up to this size; beyond, anchors go to all tiles and are pruned there.
BOX_BYTES = 64 << 20
#: Squared lengths below this keep all products and windows in 64 bits.
LENGTH_BOUND = 1 << 55
LEAST = -(1 << 62)


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and `v`, the components as floor(scale * x), of the rows that take part.

    Rows with a null id, label or vector, an empty vector, a null or non-finite component, or a
    squared length of 2^55 or more after scaling take no part. Of rows that repeat an id the
    smallest by label, then vector, counts.
    """
    e = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), e.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 30)))
    rows = rows.where("vec_id is not null and label is not null and e is not null and size(e) > 0").where(finite)
    rows = rows.withColumn("v", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))))).where(
        F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")) < float(LENGTH_BOUND)
    )
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", F.col("v").cast("array<int>").alias("v"))).alias("r")).select("vec_id", "r.label", "r.v")


@dataclass
class Level:
    """Boxes of one level of a tree: borders, labels, and the first and last child (or row) of each."""

    low: np.ndarray
    high: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Tree:
    """An R-tree over rows of integers, packed by sorting; leaves hold rows of one label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> None:
        spread = x.var(axis=0)
        axes = np.argsort(-spread, kind="stable")[:2]
        a, b = x[:, axes[0]], x[:, axes[-1]]
        order = np.lexsort((ids, a, labels))
        sizes = np.unique(labels[order], return_counts=True)[1]
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        slab_rows = np.repeat(np.ceil(np.sqrt(np.ceil(sizes / leaf_rows))).astype(np.int64) * leaf_rows, sizes)
        slab = (np.arange(len(ids)) - begin) // slab_rows
        order = order[np.lexsort((ids[order], b[order], slab, labels[order]))]
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        place = np.arange(len(ids)) - begin
        first = np.flatnonzero(place % leaf_rows == 0)
        self.levels = [self.boxes(self.x, self.x, self.labels, self.labels, first)]
        while len(self.levels[-1].first) > fanout:
            below = self.levels[-1]
            self.levels.append(self.boxes(below.low, below.high, below.label_low, below.label_high, np.arange(0, len(below.first), fanout)))
        self.length = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1).max()))

    @staticmethod
    def boxes(low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray, first: np.ndarray) -> Level:
        return Level(np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(label_low, first), np.maximum.reduceat(label_high, first), first, np.r_[first[1:], len(low)])


def intervals(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of q with a point of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    most, least = up @ high.T + down @ low.T, up @ low.T + down @ high.T
    slack = 1e-12 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    slack[slack < 0.5] = 0  # sums of this size are exact
    return least - slack, most + slack


class Best:
    """The k best (score, smaller id first) of each slot."""

    def __init__(self, slots: int, k: int) -> None:
        self.scores = np.full((slots, k), LEAST)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        touched, at = np.unique(slot, return_inverse=True)
        s = np.concatenate([self.scores[touched].ravel(), score])
        i = np.concatenate([self.ids[touched].ravel(), key])
        g = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        order = np.lexsort((i, -s, g))
        g = g[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        take = order[rank < self.k]
        self.scores[touched] = s[take].reshape(-1, self.k)
        self.ids[touched] = i[take].reshape(-1, self.k)


def search_block(tree: Tree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, same: bool, k: int) -> Best:
    """The k best rows in each of the windows [lo, hi] of each anchor; `least` is a known bound of the k-th score.

    `same` asks for other rows of the anchor's label, else for rows of other labels. lo, hi and
    least have a row for each anchor and a column for each of its windows.
    """
    n, windows = lo.shape
    best = Best(n * windows, k)
    exact = float(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1).max())) * tree.length
    kind = np.float32 if exact < 1 << 24 else np.float64 if exact < 1 << 53 else np.int64
    q_rows, q_box = q.astype(kind), q.astype(np.float64)
    floor = np.maximum(lo, least)

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Anchors (rows) that a box of the given interval can still serve, for some window."""
        bound = np.maximum(floor, best.scores[:, -1].reshape(n, windows))
        return ((high[:, None] >= bound) & (low[:, None] <= hi)).any(axis=1)

    queue: list[tuple[float, int, int, int, np.ndarray, np.ndarray]] = []
    pushed = 0

    def push(level: int, first: int, last: int) -> None:
        nonlocal pushed
        nodes = tree.levels[level]
        part = slice(first, last)
        low, high = intervals(q_box, nodes.low[part].astype(np.float64), nodes.high[part].astype(np.float64))
        if same:
            fits = (labels[:, None] >= nodes.label_low[part]) & (labels[:, None] <= nodes.label_high[part])
        else:
            fits = (labels[:, None] != nodes.label_low[part]) | (labels[:, None] != nodes.label_high[part])
        high = np.where(fits, high, -np.inf)
        top = np.minimum(high, hi.max(axis=1)[:, None]).max(axis=0)
        for c in range(last - first):
            if top[c] > -np.inf:
                pushed += 1
                heapq.heappush(queue, (-float(top[c]), pushed, level, first + c, low[:, c], high[:, c]))

    push(len(tree.levels) - 1, 0, len(tree.levels[-1].first))
    while queue:
        _, _, level, node, low, high = heapq.heappop(queue)
        use = np.flatnonzero(wanted(low, high))
        if not len(use):
            continue
        first, last = int(tree.levels[level].first[node]), int(tree.levels[level].last[node])
        if level:
            push(level - 1, first, last)
            continue
        score = q_rows[use] @ tree.x[first:last].T.astype(kind)
        bound = np.maximum(floor[use], best.scores[:, -1].reshape(n, windows)[use])
        ok = (tree.ids[first:last] != ids[use, None]) & ((tree.labels[first:last] == labels[use, None]) == same)
        hit = (score[:, None, :] >= bound[:, :, None]) & (score[:, None, :] <= hi[use][:, :, None]) & ok[:, None, :]
        r, w, c = np.nonzero(hit)
        if len(r):
            best.add(use[r] * windows + w, score[r, c].astype(np.int64), tree.ids[first + c])
    return best


def tiled(rows: DataFrame) -> DataFrame:
    """rows(vec_id, label, v) with their tile, written side by side for each tile.

    Tiles are cells of the two coordinates that vary most. Cells that ties make large are dealt
    by a hash of the id, so that no tile has more than about twice the mean.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray = np.zeros((3, 0))
        for b in batches:
            offsets, flat = lists(b.column(0))
            sizes = np.diff(offsets)
            at = np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)
            more = np.stack([np.bincount(at, weights=w) for w in (np.ones(len(flat)), flat.astype(np.float64), flat.astype(np.float64) ** 2)]) if len(flat) else np.zeros((3, 0))
            wide = max(total.shape[1], more.shape[1])
            total = np.pad(total, ((0, 0), (0, wide - total.shape[1]))) + np.pad(more, ((0, 0), (0, wide - more.shape[1])))
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = [np.frombuffer(r["m"]).reshape(3, -1) for r in rows.select("v").mapInArrow(moments, "m binary").collect()]
    wide = max((p.shape[1] for p in parts), default=0)
    n, s, ss = sum((np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts), np.zeros((3, wide)))
    axes = [int(i) for i in np.argsort(-(ss / np.maximum(n, 1) - (s / np.maximum(n, 1)) ** 2), kind="stable")[:2]] or [0]
    count = int(n[0]) if wide else 0
    tiles = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TILE_ROWS))
    side = max(1, int(np.ceil(np.sqrt(tiles))))
    shares = [k / side for k in range(1, side)]
    coordinate = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0))
    rows = rows.withColumn("a", coordinate(axes[0])).withColumn("b", coordinate(axes[-1]))
    behind = lambda borders, c: F.size(F.filter(borders, lambda x: x < F.col(c)))
    if shares and count:
        first = rows.agg(F.percentile_approx("a", shares, 10_000).alias("p")).first()["p"]
        rows = rows.withColumn("slab", behind(F.array(*[F.lit(x) for x in first]), "a"))
        cells = rows.groupBy("slab").agg(F.percentile_approx("b", shares, 10_000).alias("p"))  # one row for each slab
        rows = rows.join(F.broadcast(cells), "slab").withColumn("cell", behind(F.col("p"), "b")).drop("p")
    else:
        rows = rows.withColumn("slab", F.lit(0)).withColumn("cell", F.lit(0))
    sizes = rows.groupBy("slab", "cell").agg(F.ceil(F.count("*") / F.lit(2 * max(1, count // tiles))).alias("parts"))  # one row for each tile
    rows = rows.join(F.broadcast(sizes), ["slab", "cell"]).withColumn("tile", F.shiftleft((F.col("slab") * side + F.col("cell")).cast("long"), 24) + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return staged(rows.select("vec_id", "label", "v", "tile").repartition(tiles, "tile").sortWithinPartitions("tile", "vec_id"), "str-tiles")


@dataclass
class Boxes:
    """The bounding box of each tile (or of a part of it that one task has read)."""

    tiles: np.ndarray
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    offsets, flat = lists(column)
    return flat.reshape(len(offsets) - 1, -1).astype(np.int64)


def tile_boxes(rows: DataFrame) -> DataFrame:
    """tile, size, low and high for each tile and vector size, as far as each task sees it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, flat = lists(b.column(1))
            tiles, sizes = np.asarray(b.column(0)), np.diff(offsets)
            cuts = np.r_[0, np.flatnonzero((tiles[1:] != tiles[:-1]) | (sizes[1:] != sizes[:-1])) + 1, len(tiles)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y > x:
                    m = flat[offsets[x] : offsets[y]].reshape(y - x, -1)
                    yield pa.RecordBatch.from_pydict({"tile": pa.array([tiles[x]], pa.int64()), "size": pa.array([sizes[x]], pa.int32()), "low": pa.array([m.min(axis=0)], pa.list_(pa.int32())), "high": pa.array([m.max(axis=0)], pa.list_(pa.int32()))})

    found = rows.select("tile", "v").mapInArrow(run, "tile long, size int, low array<int>, high array<int>")
    merge = lambda side, f: F.reduce(F.collect_list(side), F.first(side), lambda x, y: F.zip_with(x, y, f))
    return found.groupBy("tile", "size").agg(merge("low", lambda x, y: F.least(x, y)).alias("low"), merge("high", lambda x, y: F.greatest(x, y)).alias("high"))


def routed(queries: DataFrame, boxes: DataFrame, first: bool) -> DataFrame:
    """queries with the tiles that they go to: the most promising one if `first`, else all others that can't be ruled out."""
    found = boxes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("size").cast("long") * 16), F.lit(0)).alias("bytes")).first()
    if found["bytes"] > BOX_BYTES:
        if first:
            return queries.withColumn("tile", F.col("home"))
        return queries.join(boxes.select(F.col("size").alias("wide"), "tile"), F.size("v") == F.col("wide")).where("tile <> home").drop("wide")
    rows = boxes.collect()
    by_size = {k: Boxes(np.array([r["tile"] for r in rows if r["size"] == k]), np.array([k]), np.array([r["low"] for r in rows if r["size"] == k], np.float64), np.array([r["high"] for r in rows if r["size"] == k], np.float64)) for k in {r["size"] for r in rows}}
    names = queries.columns
    v_at, lo_at, hi_at, least_at = (names.index(c) for c in ("v", "lo", "hi", "least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                pick, tiles = [], []
                for k, (v, lo, hi, least) in enumerate(zip(*[b.column(i).to_pylist() for i in (v_at, lo_at, hi_at, least_at)])):
                    box = by_size[len(v)]
                    low, high = (x[0] for x in intervals(np.array([v], np.float64), box.low, box.high))
                    open_ = ((high[:, None] >= np.maximum(lo, least)) & (low[:, None] <= np.array(hi))).any(axis=1)
                    gain = np.where(open_, np.minimum(high, max(hi)), -np.inf)
                    top = int(gain.argmax())
                    go = np.array([top] if open_[top] else [], dtype=np.int64) if first else np.flatnonzero(open_)
                    pick += [k] * len(go)
                    tiles += box.tiles[go].tolist()
                part = b.take(pa.array(pick, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tiles, pa.int64())], [*names, "tile"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    out = queries.mapInArrow(run, f"{kinds}, tile long")
    return out if first else out.where("not array_contains(seen, tile)")


def search(rows: DataFrame, queries: DataFrame, same: bool, k: int, parts: int) -> DataFrame:
    """anchor_id, window, id and score: the k best of every tile that a query goes to, for each window.

    queries: id, label, v, home, lo, hi, least and tile. A task reads the rows of a tile, packs them, and
    then takes the queries as they come, a block at a time.
    """
    empty = F.lit(None).cast("array<long>")
    both = rows.select("tile", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("home"), "label", F.col("vec_id").alias("id"), "v", empty.alias("lo"), empty.alias("hi"), empty.alias("least")).unionByName(
        queries.select("tile", F.lit(1).alias("kind"), "home", "label", "id", "v", "lo", "hi", "least")
    )
    both = both.repartition(parts, "tile").sortWithinPartitions("tile", "kind", F.size("v"), "home", "label", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        trees: dict[int, Tree] = {}
        tile, packed = None, False
        for whole in batches:
            tiles, kinds = np.asarray(whole.column(0)), np.asarray(whole.column(1))
            sizes = np.diff(lists(whole.column(5))[0])
            change = np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1]) | (sizes[1:] != sizes[:-1])) + 1
            cuts = np.r_[0, change, len(tiles)]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z == a:
                    continue
                if tiles[a] != tile:
                    tile, packed, held, trees = tiles[a], False, [], {}
                part = whole.slice(a, z - a)
                if kinds[a] == 0:
                    held.append((np.asarray(part.column(4)), np.asarray(part.column(3)), matrix(part.column(5)).astype(np.int32)))
                    continue
                if not packed:
                    for wide in {h[2].shape[1] for h in held}:
                        own = [h for h in held if h[2].shape[1] == wide]
                        trees[wide] = Tree(*(np.concatenate(x) for x in zip(*own)))
                    held, packed = [], True
                tree = trees.get(int(sizes[a]))
                for at in range(0, part.num_rows if tree else 0, BLOCK):
                    b = part.slice(at, BLOCK)
                    ids = np.asarray(b.column(4))
                    bounds = [b.column(c).to_pylist() for c in (6, 7, 8)]
                    windows = max(map(len, bounds[0]))
                    lo, hi, least = (np.array([x + [fill] * (windows - len(x)) for x in c], np.int64) for c, fill in zip(bounds, (0, LEAST, 0)))
                    best = search_block(tree, ids, np.asarray(b.column(3)), matrix(b.column(5)), lo, hi, least, same, k)
                    slot, place = np.nonzero(best.scores > LEAST)
                    yield pa.RecordBatch.from_pydict({"anchor_id": pa.array(ids[slot // windows], pa.int64()), "window": pa.array(slot % windows, pa.int32()), "id": pa.array(best.ids[slot, place], pa.int64()), "score": pa.array(best.scores[slot, place], pa.int64())})

    return both.mapInArrow(run, "anchor_id long, window int, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window over all tiles, with rank from 1."""
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_rows(rows: DataFrame, boxes: DataFrame, queries: DataFrame, same: bool, k: int, name: str) -> DataFrame:
    """anchor_id, window, rank, id and score of the k best rows in each window of each query, over all tiles."""
    queries = queries.withColumn("seen", F.array().cast("array<long>"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), boxes.count())
    one = staged(routed(queries, boxes, first=True), f"{name}-first")
    found = staged(search(rows, one, same, k, parts), f"{name}-found")
    full = found.groupBy("anchor_id", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = full.where(F.col("n") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("known"))
    rest = queries.drop("least", "seen").join(one.select("id", F.array("tile").alias("seen")), "id", "left").join(known.withColumnRenamed("anchor_id", "id"), "id", "left")
    least = F.transform("lo", lambda x, i: F.coalesce(F.try_element_at("known", i), F.lit(LEAST)))
    rest = rest.withColumn("least", least).withColumn("seen", F.coalesce("seen", F.array().cast("array<long>"))).drop("known").select(*queries.columns)
    more = search(rows, routed(rest, boxes, first=False), same, k, parts)
    return ranked(found.unionByName(more), k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives for every row of `vectors(vec_id, label, v)` that `anchors` marks, by integer inner products.

    For each anchor and each of its first `positives` rows of the same label: the first `negatives` rows of
    other labels whose score is from `low` to `high` per cent of the positive's. Columns: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Higher scores come first, ties by
    smaller id. Anchors without a positive, and positives without a row in their window, have no row;
    vectors of another length than the anchor's are not compared with it. All rows are searched; the
    ids must be distinct and vectors sound, as `quantised` returns them. An empty table gives an empty one.
    """
    rows = tiled(vectors)
    boxes = staged(tile_boxes(rows), "str-boxes")
    asked = rows.where(anchors).select(F.col("vec_id").alias("id"), "label", "v", F.col("tile").alias("home"))
    all_scores = asked.withColumn("lo", F.array(F.lit(LEAST))).withColumn("hi", F.array(F.lit(-LEAST))).withColumn("least", F.array(F.lit(LEAST)))
    near = staged(best_rows(rows, boxes, all_scores, True, positives, "positives"), "positives")
    cut = lambda share: F.expr(f"({share} * score - pmod({share} * score, 100)) div 100")  # noqa: E731  floor of a hundredth
    windows = near.select("anchor_id", "rank", "score", (-cut(-low)).alias("lo"), cut(high).alias("hi")).where("lo <= hi")
    listed = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "lo", "hi"))).alias("w"))
    queries = asked.join(listed.withColumnRenamed("anchor_id", "id"), "id").select(*asked.columns, F.col("w.rank").alias("ranks"), F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), F.transform("w", lambda x: F.lit(LEAST)).alias("least"))
    queries = staged(queries, "windows")
    found = best_rows(rows, boxes, queries.drop("ranks"), False, negatives, "negatives")
    placed = found.join(queries.select(F.col("id").alias("anchor_id"), "ranks"), "anchor_id").withColumn("of", F.get("ranks", F.col("window"))).select("anchor_id", "of", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor_id", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return placed.join(pairs, ["anchor_id", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
