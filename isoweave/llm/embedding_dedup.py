"""Operator 2: embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoweave.llm.shared import components, lists, roots, staged


#: Hashes that are held at once.
CELLS = 1 << 21


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    offsets, values = lists(column)
    x = np.asarray(values, dtype=np.float64).reshape(len(offsets) - 1, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # the squares of large or tiny components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def passes_needed(rows: int, threshold: float, window: int, recall: float, least: int = 16, mean: float = 0.0) -> int:
    """Passes after which a pair at the threshold has met with the target recall.

    `mean` is the mean cosine of all pairs. Hashes look at what is left of the vectors without their
    mean, where a pair at the threshold has (threshold - mean) / (1 - mean); where that would be below
    0.5, links are so dense that it counts as 0.5. Two such vectors agree in a hash with
    1 - angle / pi. A pass parts all vectors into runs of `window` by log2(rows / window) hashes; the
    pair meets if it agrees in those.
    """
    left = max(min(0.5, threshold), (threshold - mean) / (1 - mean)) if 0 < mean < 1 else threshold
    agree = 1 - math.acos(left) / math.pi
    met = agree ** max(0.0, math.log2(max(rows, 1) / window))
    return max(least, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else least


def _means(reps: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number and mean of the unit vectors of each length: one row of sums for each task and length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            size = np.diff(lists(batch.column(0))[0])
            for d in np.unique(size).tolist():
                x = _matrix(batch.column(0).take(pa.array(np.flatnonzero(size == d))))
                total[d] = total.get(d, 0.0) + np.r_[len(x), x.sum(axis=0)]
        for d, t in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "t": pa.array([t.tobytes()], pa.binary())})

    found: dict[int, np.ndarray] = {}
    for r in reps.select("v").mapInArrow(sums, "d int, t binary").collect():
        found[r["d"]] = found.get(r["d"], 0.0) + np.frombuffer(r["t"])
    return {d: (int(t[0]), t[1:] / t[0]) for d, t in found.items()}


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, recall: float = 0.99, bits: int = 62, window: int = 48, block: int = 512, seed: int = 7) -> DataFrame:
    """Links vectors whose cosine reaches `threshold`: columns vec_id, n_links, component_id, kept.

    Each pass orders all vectors by `bits` concatenated random-hyperplane hashes of what differs from
    their mean and compares every vector with the `window` next ones; the number of passes follows from
    that of vectors and from how alike all of them are. Verified links of all passes are united. A window bounds the
    partners that a pass sees, so afterwards all pairs inside each component are compared in blocks
    of `block` vectors; n_links counts those, in double precision.

    Null vectors, zero vectors and those with null or non-finite components link with nothing.
    Vectors of different length don't link. Equal vectors are compared once and counted as often
    as they occur. Rows that repeat an id are one vector (the smallest by value); the result has
    one row for each id, null included. Long vectors are read whole; an empty table gives an empty
    one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.where("vec_id is not null and v is not null and size(v) > 0").where(~bad).where(F.exists("v", lambda x: x != 0))
    # -0.0 and 0.0 are the same component
    sound = sound.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("same", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    member = staged(sound.select("vec_id", "same", "v"), "vectors")
    reps = staged(member.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vector-classes")

    means = _means(reps)
    shared = lambda n, m: (n * float(m @ m) - 1) / (n - 1) if n > 1 else 0.0  # noqa: E731  mean cosine of different vectors
    passes = max((passes_needed(n, threshold, window, recall, mean=shared(n, m)) for n, m in means.values()), default=1)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = lists(batch.column(1))
            size = np.diff(offsets)
            ids = np.asarray(batch.column(0))
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                planes = np.random.default_rng([seed, d]).standard_normal((d, passes * bits))
                weights = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
                several = max(1, CELLS // (passes * bits))
                for first in range(0, len(at), several):
                    own = at[first : first + several]
                    x = _matrix(batch.column(1).take(pa.array(own))) - means[d][1]
                    key = (x @ planes > 0).reshape(len(own), passes, bits) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own) * passes, d, dtype=np.int32)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(own))), pa.array(key.reshape(-1)), pa.array(np.repeat(ids[own], passes))],
                        ["dim", "pass", "key", "rep"],
                    )

    keys = reps.select("rep", "v").mapInArrow(hashes, "dim int, pass int, key long, rep long")
    ordered = staged(keys.sort("dim", "pass", "key", "rep").select("dim", "pass", "rep", F.monotonically_increasing_id().alias("place")), "vector-order")
    # partitions hold consecutive stretches of the order: their sizes turn places into ranks
    part = F.shiftrightunsigned("place", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).count().collect())  # one row for each partition
    starts = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    begin = spark.createDataFrame([(r["part"], n) for r, n in zip(sizes, starts)], "part long, begin long")
    span = max(4 * window, 256)
    rank = ordered.withColumn("part", part).join(F.broadcast(begin), "part").withColumn("rank", F.col("begin") + F.col("place").bitwiseAND((1 << 33) - 1)).withColumn("cell", F.floor(F.col("rank") / span).cast("long"))
    # the first rows of a cell are also the last partners of the cell before
    spread = rank.withColumn("cell", F.explode(F.when((F.col("rank") % span < window) & (F.col("cell") > 0), F.array("cell", F.col("cell") - 1)).otherwise(F.array("cell"))))

    def compare(t: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(t.column("rank")))
        ids, kind = np.asarray(t.column("rep"))[order], (np.asarray(t.column("dim")).astype(np.int64) * (1 << 20) + np.asarray(t.column("pass")))[order]
        a, b = [], []
        for k in np.unique(kind):
            own = np.flatnonzero(kind == k)
            x = _matrix(t.column("v").combine_chunks().take(pa.array(order[own])))
            near = np.triu(x @ x.T >= threshold, 1)
            i, j = np.nonzero(near & ~np.triu(near, window + 1))
            a.append(own[i])
            b.append(own[j])
        left, right = np.concatenate(a), np.concatenate(b)
        # one link to the smallest id of each piece says the same as all pairs
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        label = roots(len(ids), place[left], place[right])
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": ids[by_id][moved], "b": ids[by_id][label[moved]]})

    links = spread.join(reps.select("rep", "v"), "rep").select("cell", "rank", "dim", "pass", "rep", "v").groupBy("cell").applyInArrow(compare, "a long, b long")
    found = staged(components(links, "vector"), "vector-components")

    in_blocks = found.join(found.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("n")), "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = in_blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("component", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def count(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        x, own = _matrix(t.column("v")), np.asarray(t.column("own"))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= own[:, None] != own[None, :]
        return pa.table({"rep": t.column("node"), "n": near @ np.asarray(t.column("copies"))})

    counted = pairs.join(reps.select(F.col("rep").alias("node"), "copies", "v"), "node").groupBy("component", "i", "j").applyInArrow(count, "rep long, n long")
    result = (
        member.select("vec_id", "same").join(reps.select("same", "rep", "copies"), "same")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counted.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        .select("vec_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    whole = rows.select("vec_id").join(result, "vec_id", "left")
    return whole.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
