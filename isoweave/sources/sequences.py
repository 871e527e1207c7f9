"""FASTA and FASTQ, read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.sources.text import numbered


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id (the whole header line) and seq; sequence lines are joined."""
    raw = spark.read.option("lineSep", "\n>").text(paths)
    record = F.regexp_replace("value", "^>", "")
    return raw.where(F.trim("value") != "").select(
        F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "").alias("id"),
        F.regexp_replace(F.regexp_replace(record, "^[^\n]*", ""), r"\s", "").alias("seq"),
    )


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, seq and qual of four-line records, told apart by the line numbers of each file."""
    rows = numbered(spark, paths).select("file", F.floor(F.col("n") / 4).alias("record"), (F.col("n") % 4).alias("part"), F.regexp_replace("value", "\r$", "").alias("value"))
    wide = rows.where("part <> 2").groupBy("file", "record").agg(*[F.max(F.when(F.col("part") == k, F.col("value"))).alias(n) for k, n in ((0, "id"), (1, "seq"), (3, "qual"))])
    return wide.where("seq is not null").select(F.regexp_replace("id", "^@", "").alias("id"), "seq", "qual")


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual")).write.text(path)


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq")).write.text(path)
