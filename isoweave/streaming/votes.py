"""Votes from a stream of shards: they are additive, so each micro-batch is a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from isoweave.operators.votes import tally


def running_votes(votes: DataFrame) -> DataFrame:
    """Summed weight by (id, pos, allele) over all that has come so far; for update or complete mode."""
    return votes.groupBy("id", "pos", "allele").agg(F.sum("weight").alias("weight"))


def shards_to(votes: DataFrame, folder: str) -> DataStreamWriter:
    """Writes the tally of each micro-batch as a shard of its own; a batch that is run again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        running_votes(batch).write.mode("overwrite").parquet(f"{folder}/shard={number}")

    return votes.writeStream.foreachBatch(write)


def merged(spark, folder: str, prior: DataFrame) -> DataFrame:
    """The tally over all shards, with the prior once."""
    return tally(spark.read.parquet(folder), prior)
