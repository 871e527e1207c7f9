"""Helpers that several training-data operators use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.sources.scratch import shared_folder, written

def work_dir(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's; it can go when its results are read."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and rereads it, which cuts the lineage for good."""
    return written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(df: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """`df` with every column but the needed ones under a name that no operator uses, and the new names by the old.

    `df.withColumnsRenamed({new: old ...})` brings the names back, so that columns of any name come through.
    """
    names = {c: f"_extra_{i}" for i, c in enumerate(df.columns) if c not in needed}
    return df.select(*needed, *[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def hot_join(rows: DataFrame, dim: DataFrame, keys: list[str], by: list[str], how: str = "inner", spread: int = 64, share: int = 2048) -> DataFrame:
    """rows.join(dim, keys, how) for `rows` of which one key may hold a large part.

    Keys with more than one in `share` of all rows are at most `share` in number, a bound that holds at any size.
    Their rows are dealt, by a hash of the columns `by`, over `spread` copies of the key's few rows in `dim`; `how`
    is inner or left.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = counts.where(F.col("_n") > F.lit(max(1000, total // share))).select(*keys, F.lit(True).alias("_hot"))
    hot = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)
    given = [c for c in rows.columns if c not in keys]
    own = [c for c in dim.columns if c not in keys]
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(spread)).cast("int")).otherwise(0)).drop("_hot")
    copied = dim.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(copied, [*keys, "_salt"], how).select(*keys, *given, *own)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def utf8(col: str) -> Column:
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of an Arrow list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0], np.asarray(column.flatten())


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words, so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a stream of batches, sorted by the keys, into one table for each key.

    Holds one group at a time beside the batch being read.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


class Coder:
    """Tokens as 64-bit words, remembered for the tokens met so far."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, token: str) -> int:
        code = self.known.get(token)
        if code is None:
            if len(self.known) > 100_000:
                self.known.clear()
            code = self.known[token] = xxhash.xxh64_intdigest(token)
        return code


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the given links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest reachable node for every node of `edges(a, b)`: columns node, component.

    Alternates large-star and small-star contraction; each round is aggregated before it is
    joined and written to the shared folder. Ends when a round leaves the links unchanged.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a")
        after = small.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(least.select("a", F.col("low").alias("b"))).distinct()
        now = staged(after, f"{name}-links")
        seen, before = mark(now), seen
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def one_text_by_id(docs: DataFrame) -> DataFrame:
    """doc_id (long, not null) and text: rows that repeat an id are one document with the smallest text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows
