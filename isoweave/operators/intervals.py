"""Interval unions, range joins and neighbours, all without a cartesian product."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _marked(df: DataFrame, keys: list[str], start: str, end: str, touching: bool, name: str) -> DataFrame:
    """Adds `name`: islands of each key in one order, numbered from 1."""
    order = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach if touching else F.col(start) >= reach), 1).otherwise(0)
    # the sum takes equal intervals together, so their order doesn't matter
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(order)).drop("_opens")


def _local(df: DataFrame, keys: list[str], start: str, end: str, touching: bool, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their cell and the island inside it, unions of those with their island of the key)."""
    own = [*keys, "_cell"]
    rows = _marked(df.withColumn("_cell", F.floor(F.col(start) / width)), own, start, end, touching, "_part")
    unions = rows.groupBy(*own, "_part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("_n"))
    return rows, _marked(unions, keys, start, end, touching, "island")


def islands(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", touching: bool = True, width: int = 100_000) -> DataFrame:
    """Adds `island`, numbered from 1 by start: intervals of one key that overlap, directly or not.

    With `touching` intervals that share a border are one island, without they are two. Intervals are
    united first among those that start in one cell of `width`; only those unions of a key pass one
    order. Keys must not be null.
    """
    rows, unions = _local(df, keys, start, end, touching, width)
    return rows.join(unions.select(*keys, "_cell", "_part", "island"), [*keys, "_cell", "_part"]).select(*df.columns, "island")


def merge(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", touching: bool = True, width: int = 100_000) -> DataFrame:
    """keys, start, end, n: the union of the intervals and how many each part has taken in."""
    _, unions = _local(df, keys, start, end, touching, width)
    return unions.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("island")


def bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, left_range: tuple[Column, Column], right_range: tuple[Column, Column], width: int, how: str = "inner") -> DataFrame:
    """Joins rows of equal keys whose ranges overlap (borders included) and which meet `condition`.

    With how="left" rows without a partner come too, their other columns null. Both sides are dealt
    into bins of `width`; a pair is joined in the bin where the later of the two
    ranges begins, so it comes once. Key columns come from the left side; other columns of the two
    sides must have different names.
    """
    l = left.withColumn("_ls", left_range[0]).withColumn("_le", left_range[1]).withColumn("_bin", F.explode(bins(F.col("_ls"), F.col("_le"), width)))
    r = right.withColumn("_rs", right_range[0]).withColumn("_re", right_range[1]).withColumn("_bin", F.explode(bins(F.col("_rs"), F.col("_re"), width)))
    once = F.col("_bin") == F.floor(F.greatest("_ls", "_rs") / width)
    met = l.join(r, [*keys, "_bin"]).where(once & (F.col("_ls") <= F.col("_re")) & (F.col("_rs") <= F.col("_le")) & condition).drop("_ls", "_le", "_rs", "_re", "_bin")
    if how == "inner":
        return met
    # rows are told apart by their columns: row numbers may come out otherwise when a task runs again
    found = met.select(*[F.col(c).alias(f"_f_{c}") for c in left.columns]).distinct()
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in left.columns])
    alone = left.join(found, same, "left_anti")
    own = [c for c in right.columns if c not in keys]
    kinds = dict(right.dtypes)
    return met.unionByName(alone.select(*left.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in own]))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def neighbour_window(loci: DataFrame, keys: list[str], window: int, start: str = "s", end: str = "e") -> DataFrame:
    """Adds prev_gap, next_gap and win: the window, or a third of the smaller gap if that is tight.

    A gap is tight if it is at most twice the window. Locus order is by start, then end.
    """
    order = W.partitionBy(*keys).orderBy(start, end)
    gaps = loci.withColumn("prev_gap", F.col(start) - F.lag(end).over(order)).withColumn("next_gap", F.lead(start).over(order) - F.col(end))
    least = F.least("prev_gap", "next_gap")  # nulls are skipped
    return gaps.withColumn("win", F.when(least <= 2 * window, (least / 3).cast("long")).otherwise(F.lit(window).cast("long")))
