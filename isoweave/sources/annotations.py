"""refFlat, BED, bedGraph, border and side tables, and the vote report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.functions.seq import fixed2, fixed3, plain_number
from isoweave.sources.text import columns, int_array, last_by_key, lines, numbered, with_chr

REFFLAT = ("gene", "tx", "chr", "strand", "tx_start", "tx_end", "cds_start", "cds_end", "n_exon", "exon_starts", "exon_ends", "members")


def read_refflat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each transcript; members is null without a twelfth column."""
    raw = columns(lines(spark, paths, "^(?:[@#]|track)"), *REFFLAT).where("n_cols >= 11")
    whole = {c: F.col(c).cast("long") for c in ("tx_start", "tx_end", "cds_start", "cds_end")}
    return raw.withColumns(whole | {"chr": with_chr(F.col("chr")), "n_exon": F.col("n_exon").cast("int"), "exon_starts": int_array(F.col("exon_starts")), "exon_ends": int_array(F.col("exon_ends")), "members": F.split("members", ",")}).drop("n_cols")


def write_refflat(df: DataFrame, path: str, trailing_comma: bool = False) -> None:
    """Eleven columns; a twelfth has the members or, for annotation files, the gene name."""
    csv = lambda c: F.concat(F.array_join(F.col(c).cast("array<string>"), ","), F.lit("," if trailing_comma else ""))
    plain = [F.col(c).cast("string") for c in REFFLAT[:9]]
    last = [F.array_join("members", ",")] if "members" in df.columns else ["gene_name"] if "gene_name" in df.columns else []
    df.select(F.concat_ws("\t", *plain, csv("exon_starts"), csv("exon_ends"), *last)).write.text(path)


def read_junction_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Junctions from BED6 (start, end) or BED12 (the gap between the two blocks), with score."""
    names = ("chr", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "n_blocks", "sizes", "starts")
    raw = columns(lines(spark, paths, "^(?:track|Junction)"), *names)
    sizes = int_array(F.col("sizes"))
    twelve = F.col("n_cols") >= 12
    return raw.select(
        "line_no", with_chr(F.col("chr")).alias("chr"), "strand",
        (F.col("start").cast("long") + F.when(twelve, F.get(sizes, F.lit(0))).otherwise(0)).alias("left"),
        (F.col("end").cast("long") - F.when(twelve, F.get(sizes, F.lit(1))).otherwise(0)).alias("right"),
        F.col("score").cast("double").alias("score"),
    )


def read_bed6(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = columns(lines(spark, paths, "^track"), "chr", "start", "end", "name", "score", "strand")
    return raw.select("line_no", "chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name", F.col("score").cast("double").alias("score"), "strand")


def write_bed12(df: DataFrame, path: str, track: str) -> None:
    """Part files that make one BED file when joined in order: the first holds the track line alone."""
    spark = df.sparkSession
    csv = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    body = df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("chr", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "n_blocks")], csv("sizes"), csv("starts")).alias("value"))
    head = spark.range(1, numPartitions=1).select(F.lit(f'track name="{track}" description="{track}"').alias("value"))
    head.unionByName(body).write.text(path)


def read_bedgraph(spark: SparkSession, paths: str | list[str], swap: bool = False) -> DataFrame:
    """chr, start, end, value, strand, line_no; the track line of each file names its strand.

    A `plus` track covers the minus strand and the other way round, unless `swap`. Files without such
    a track line are left out.
    """
    raw = numbered(spark, paths).select("file", "line_no", "value")
    plus, minus = ("+", "-") if swap else ("-", "+")
    named = F.when(F.contains("value", F.lit("plus")), plus).when(F.contains("value", F.lit("minus")), minus)
    strand = raw.where(F.col("value").startswith("track")).groupBy("file").agg(F.max(named).alias("strand")).where("strand is not null")
    c = F.split("value", r"\s+")
    return raw.where(~F.col("value").startswith("track")).join(strand, "file").select(
        F.get(c, F.lit(0)).alias("chr"), F.get(c, F.lit(1)).cast("long").alias("start"), F.get(c, F.lit(2)).cast("long").alias("end"), F.get(c, F.lit(3)).cast("double").alias("value"), "strand", "line_no")


def read_borders(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = columns(lines(spark, paths), "chr", "left", "right", "gl", "strand", "start", "end")
    return last_by_key(raw.withColumns({c: F.col(c).cast("long") for c in ("left", "right", "start", "end")}), "chr", "strand", "start").drop("n_cols")


def read_wells(spark: SparkSession, paths: str | list[str], version: int = 1) -> DataFrame:
    """zmw, productive, and from version 2 on read_len and median_insert, of well status CSV."""
    at = {"productive": 9} if version == 1 else {"read_len": 9, "productive": 10, "median_insert": 11}
    c = F.split("value", ",")
    fields = [F.regexp_replace(F.get(c, F.lit(i)), r"\s", "").alias(n) for n, i in at.items()]
    return lines(spark, paths, "Zmw").select(F.get(c, F.lit(0)).alias("zmw"), *fields).withColumn("productive", F.col("productive").try_cast("int"))


def read_side_table(spark: SparkSession, paths: str | list[str], *names: str) -> DataFrame:
    """Key and values; the last line of a key counts."""
    return last_by_key(columns(lines(spark, paths), *names), names[0]).drop("n_cols", "line_no")


def read_votes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """id, pos, allele, weight from vote reports (`allele=weight;…` in the sixth column)."""
    raw = columns(lines(spark, paths), "id", "pos", "max", "sum", "frac", "alleles")
    each = raw.select("id", F.col("pos").cast("int").alias("pos"), F.explode(F.split("alleles", ";")).alias("a")).where(F.contains("a", F.lit("=")))
    return each.select("id", "pos", F.substring_index("a", "=", 1).alias("allele"), F.substring_index("a", "=", -1).cast("double").alias("weight"))


def vote_report(piled: DataFrame) -> DataFrame:
    """Lines of a vote report, sorted by id and position when written with write.text."""
    alleles = F.array_join(F.transform("alleles", lambda x: F.concat(x["allele"], F.lit("="), plain_number(x["w"]))), ";")
    line = F.concat_ws("\t", "id", F.col("pos").cast("string"), plain_number(F.col("max")), plain_number(F.col("sum")), fixed3("frac"), alleles)
    return piled.orderBy("id", "pos").select(line.alias("value"))


def coverage_report(called: DataFrame) -> DataFrame:
    return called.select(F.concat_ws("\t", "id", F.col("covered").cast("string"), F.col("len").cast("string"), fixed2("ratio")).alias("value"))


def write_mask(called: DataFrame, path: str) -> None:
    """FASTA of the coverage masks."""
    called.select(F.concat(F.lit(">"), F.col("id").cast("string"), F.lit("\n"), "mask")).write.text(path)


def read_spec(text: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """Tab-separated settings; lines without a key and a value are skipped."""
    rows = [line.split("\t") for line in text.splitlines()]
    spec = {"Bowtie2_threads": "1", "Remove_tmp_files": "yes", "Output_folder": "output"} | {r[0]: r[1] for r in rows if len(r) > 1 and r[0]}
    if missing := [k for k in required if k not in spec]:
        raise ValueError(f"settings are missing: {', '.join(missing)}")
    return spec
