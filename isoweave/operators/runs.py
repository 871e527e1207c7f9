"""Runs of equal keys in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_lengths(rows: DataFrame, order: str, key: str, width: int = 10_000) -> DataFrame:
    """run (from 1), key, first, last, n: consecutive rows with one key.

    Runs are counted inside stretches of `width` order values. One row for each stretch, with its
    number of runs and its first and last key, passes the global order and says where runs go on.
    """
    cell = W.partitionBy("_cell").orderBy(order)
    local = rows.withColumn("_cell", F.floor(F.col(order) / width)).withColumn("_new", F.when(F.col(key).eqNullSafe(F.lag(key).over(cell)) & (F.row_number().over(cell) > 1), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(cell))
    short = local.groupBy("_cell", "_run", key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    stretch = short.groupBy("_cell").agg(F.count("*").alias("_runs"), F.min_by(F.struct(key), "_run").alias("_head"), F.max_by(F.struct(key), "_run").alias("_tail"))
    whole = W.orderBy("_cell")
    goes_on = F.when(F.col("_head").eqNullSafe(F.lag("_tail").over(whole)), 1).otherwise(0)
    stretch = stretch.withColumn("_on", goes_on).withColumn("_before", F.sum(F.col("_runs") - F.col("_on")).over(whole) - F.col("_runs"))
    numbered = short.join(stretch.select("_cell", "_before"), "_cell").withColumn("run", F.col("_before") + F.col("_run"))
    return numbered.groupBy("run", key).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
