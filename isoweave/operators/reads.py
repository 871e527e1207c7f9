"""Which reads are used: productive wells, circular consensus before subreads, whole wells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoweave.sources.scratch import written


def productive(wells: DataFrame) -> DataFrame:
    return wells.where(F.col("productive") == 1).select("zmw").distinct()


def well_of(header: Column) -> Column:
    """Second part of movie/zmw/…"""
    return F.get(F.split(header, "/"), F.lit(1))


def extract(reads: DataFrame, wells: DataFrame) -> DataFrame:
    """Reads of `reads(zmw, …)` whose well is productive."""
    return reads.join(productive(wells), "zmw", "left_semi")


def extract_subreads(subreads: DataFrame, consensus: DataFrame, wells: DataFrame) -> DataFrame:
    """Subreads of productive wells that have no consensus read in their movie or an earlier one.

    Tables have movie and zmw; wells are productive by movie.
    """
    first = consensus.groupBy("zmw").agg(F.min("movie").alias("_first"))
    own = wells.where(F.col("productive") == 1).select("movie", "zmw").distinct()
    used = subreads.join(own, ["movie", "zmw"], "left_semi")
    return used.join(first, "zmw", "left").where(F.col("_first").isNull() | (F.col("_first") > F.col("movie"))).drop("_first")


def separate_ccs(subreads: DataFrame, consensus: DataFrame) -> DataFrame:
    """Subreads of `(well, …)` whose well has no consensus read."""
    return subreads.join(consensus.select("well").distinct(), "well", "left_anti")


def read_parts(read_id: Column) -> dict[str, Column]:
    """Named parts of a structured read id."""
    c = F.split(read_id, "_")
    names = ("kind", "well", "rawlen", "start", "end", "len", "sub", "code", "polya")
    return {n: F.get(c, F.lit(i)).cast("long") if n in ("rawlen", "start", "end", "len", "polya") else F.get(c, F.lit(i)) for i, n in enumerate(names)}


def whole_wells(reads: DataFrame, bad: Column, well: str = "well") -> DataFrame:
    """Drops every read of a well that has a bad one."""
    return reads.join(reads.where(bad).select(well).distinct(), well, "left_anti")


def on_known_references(alignments: DataFrame, references: DataFrame) -> DataFrame:
    """Alignments to one of `references(id)`."""
    return alignments.join(references.select(F.col("id").alias("rname")).distinct(), "rname", "left_semi")


def in_well_order(subreads: DataFrame, well: str = "zmw", start: str = "start", rest: str = "id") -> DataFrame:
    """Sorted by well and start as numbers, then by text."""
    return subreads.orderBy(F.col(well).cast("long"), F.col(start).cast("long"), F.col(rest).cast("string"))


def file_list(paths: DataFrame) -> DataFrame:
    """Distinct paths of `paths(path)`, sorted."""
    return paths.select("path").distinct().orderBy("path")


def renamed_ids(trimmed: DataFrame, prefix: str, cell_rows: int = 100_000) -> DataFrame:
    """id_map(id, new_id) of kept reads: `prefix` and a number by the order of the ids.

    Ids are dealt into ranges of about `cell_rows`, which follow each other; numbers are counted in each
    range, whose first number comes from the sizes of those before it. The ranges are written, as they
    come from a sample.
    """
    ids = trimmed.where("status = 'kept' and id is not null").select("id").distinct()
    cells = max(1, ids.count() // cell_rows)
    dealt = written(ids.repartitionByRange(cells, "id").withColumn("_cell", F.spark_partition_id()), "ranges-of-ids")
    start = dealt.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", (F.sum("_n").over(W.orderBy("_cell")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.row_number().over(W.partitionBy("_cell").orderBy("id"))
    return dealt.join(F.broadcast(start), "_cell").select("id", F.concat(F.lit(prefix), number.cast("string")).alias("new_id"))
