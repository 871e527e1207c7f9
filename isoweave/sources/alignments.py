"""SAM, GFF3 and GTF scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.sources.text import lines


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignment lines: qname, flag, rname, pos (from 1), cigar, seq, tags and md (first MD tag)."""
    c = F.split("value", "\t")
    cut = lines(spark, paths, "^[@#]").withColumn("c", c).where(F.size("c") >= 10)
    tags = F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0)))
    return cut.select(
        "line_no", F.get("c", F.lit(0)).alias("qname"), F.get("c", F.lit(1)).cast("int").alias("flag"), F.get("c", F.lit(2)).alias("rname"),
        F.get("c", F.lit(3)).cast("long").alias("pos"), F.get("c", F.lit(5)).alias("cigar"), F.get("c", F.lit(9)).alias("seq"), tags.alias("tags"),
        F.regexp_replace(F.get(F.filter(tags, lambda t: F.contains(t, F.lit("MD"))), F.lit(0)), "^MD:Z:", "").alias("md"),
    )


def read_gff3(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """chr, feature, start (from 1), end, score, strand and the attributes as a map and as text."""
    c = F.split("value", "\t")
    return lines(spark, paths, "^#").withColumn("c", c).where(F.size("c") >= 9).select(
        "line_no", F.get("c", F.lit(0)).alias("chr"), F.get("c", F.lit(2)).alias("feature"), F.get("c", F.lit(3)).cast("long").alias("start"), F.get("c", F.lit(4)).cast("long").alias("end"),
        F.get("c", F.lit(5)).try_cast("double").alias("score"), F.get("c", F.lit(6)).alias("strand"), F.get("c", F.lit(8)).alias("attr_text"),
        F.map_from_entries(F.transform(F.filter(F.array_distinct(F.split(F.get("c", F.lit(8)), ";")), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")))).alias("attrs"),
    )


def read_gtf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """As GFF3, with gene_id, transcript_id and gene_name from `key "value";` attributes."""
    c = F.split("value", "\t")
    cut = lines(spark, paths, "^#").withColumn("c", c).where(F.size("c") >= 9)
    named = lambda k: F.nullif(F.regexp_extract(F.get("c", F.lit(8)), rf'{k}\s*"([^"]*)"', 1), F.lit(""))
    return cut.select(
        "line_no", F.get("c", F.lit(0)).alias("chr"), F.get("c", F.lit(2)).alias("feature"), F.get("c", F.lit(3)).cast("long").alias("start"), F.get("c", F.lit(4)).cast("long").alias("end"),
        F.get("c", F.lit(6)).alias("strand"), named("gene_id").alias("gene_id"), named("transcript_id").alias("transcript_id"), named("gene_name").alias("gene_name"),
    )
