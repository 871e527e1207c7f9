"""Where queries of the transcript operators are registered, each with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.operators import convert
from isoweave.plans.inputs import load, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers f(get) under its name; get(name) is a derived input or a table."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


def transcripts(get: Callable) -> DataFrame:
    exons = get("exons")
    flat = convert.collect_exons(exons, "tx", "chr", "strand")
    return flat.withColumn("gene", F.concat(F.lit("g"), F.floor(F.col("tx_start") / 2000).cast("string")))
