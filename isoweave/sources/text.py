"""Line tables: the text formats that the other readers cut into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, n (line number in its file, from 0), line_no (over all files, sorted by path) and value.

    Files are read in splits, in parallel and in any order. A line's number is that of its split's
    first line, summed up over the splits in front of it, plus its place in the split.
    """
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")
    raw = spark.read.text(paths).select(*at, F.monotonically_increasing_id().alias("_id"), "value")
    splits = raw.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # one row for each split of the input, which all tasks are given
    before = lambda w: F.sum("_n").over(w) - F.col("_n")
    starts = splits.select("file", "_block", "_first", before(W.partitionBy("file").orderBy("_block")).alias("_own"), before(W.orderBy("file", "_block")).alias("_all"))
    place = F.col("_id") - F.col("_first")
    return raw.join(F.broadcast(starts), ["file", "_block"]).select("file", (F.col("_own") + place).alias("n"), (F.col("_all") + place).alias("line_no"), "value")


def lines(spark: SparkSession, paths: str | list[str], skip: str | None = None) -> DataFrame:
    """line_no and value of every line; lines that match `skip` are left out.

    line_no counts the lines of all files, sorted by path, so it decides what came first.
    """
    read = numbered(spark, paths).select("line_no", F.regexp_replace("value", "\r$", "").alias("value"))
    return read.where(~F.col("value").rlike(skip)) if skip else read


def columns(df: DataFrame, *names: str, sep: str = "\t") -> DataFrame:
    """line_no and the named columns of each line, by position; missing ones are null."""
    cut = df.withColumn("_c", F.split("value", sep))
    return cut.select("line_no", *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)], F.size("_c").alias("n_cols"))


def last_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key, as when later lines overwrite earlier ones."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("line_no")))).where("_n = 1").drop("_n")


def int_array(csv: Column) -> Column:
    """`1,2,3,` as integers."""
    return F.transform(F.filter(F.split(csv, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))


def with_chr(chrom: Column, prefix_only: bool = True) -> Column:
    """Adds chr where it is missing (at the start, or anywhere in the name)."""
    has = chrom.startswith("chr") if prefix_only else F.contains(chrom, F.lit("chr"))
    return F.when(has, chrom).otherwise(F.concat(F.lit("chr"), chrom))


def without_chr(chrom: Column) -> Column:
    """Takes chr from the front of a name."""
    return F.regexp_replace(chrom, "^chr", "")


def renamed(df: DataFrame, names: DataFrame | None, column: str = "chr") -> DataFrame:
    """Replaces names by `names(old, new)`; names that are not listed stay."""
    if names is None:
        return df
    new = names.groupBy("old").agg(F.first("new").alias("_new"))
    return df.join(new, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("_new", column)).drop("old", "_new")
