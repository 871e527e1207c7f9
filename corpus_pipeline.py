"""The corpus pipeline: each stage works on all that the one before kept.

Language ID, n-gram Jaccard join, suffix-order deduplication, benchmark decontamination, mixing.
All stages but the last return the columns of documents, and columns of any name come through. Rows
with a null doc_id are judged like others, by an id made from their text; of rows that repeat an id
the Jaccard stage keeps one. Null texts go in the first stage; in later ones they count as empty.
Long texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm import decontaminate, jaccard_join, language_id, mixing, suffix_dedup
from isoweave.llm.shared import crc_mod, masked, staged, table

#: Below this share of a language's regression target a text is no known language. One of four
#: languages by chance alone would have 0.25, short clean texts have more.
LEAST_LANGUAGE_SCORE = 0.1


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Documents with text, a doc_id that is never null, and their own columns under other names.

    A null id becomes a hash of the text above all usual ids, so equal texts without an id are one
    document and come behind those with one. The second value has the new names by the old.
    """
    rows, names = masked(docs, "text")
    own = (F.lit(1).cast("long") * (1 << 62)) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    return rows.withColumn("doc_id", F.coalesce(F.col(names["doc_id"]), own)), names


def renamed(docs: DataFrame, rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """`rows` of numbered(docs) with the columns of `docs`."""
    return rows.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letters or resemble no known language; repeated rows alike."""
    rows, names = masked(docs, "doc_id", "text", "lang")
    judged = language_id.identify(rows, crc_mod("doc_id", 4) == 2)
    return renamed(docs, judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents.

    Of rows that repeat an id the one stays that is smallest by text, then by the other columns.
    """
    rows, names = numbered(docs)
    kept = rows.join(jaccard_join.join(rows).where("kept").select("doc_id"), "doc_id", "left_semi")
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        order = F.struct("text", *names.values())
        kept = kept.groupBy("doc_id").agg(F.min(order).alias("_row")).select("doc_id", "_row.*")
    return renamed(docs, kept, names)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 100 or more that occur earlier; documents with nothing left go.

    n_chars is that of the text that is left.
    """
    rows, names = numbered(docs)
    kept = suffix_dedup.remove_repeats(rows, length=100, keep=tuple(names.values()), as_text=True).withColumnRenamed("kept", "text")
    if "n_chars" in names:
        kept = kept.withColumn(names["n_chars"], F.length("text").cast(docs.schema["n_chars"].dataType))
    return renamed(docs, kept.where(F.col("text").rlike(r"\S")), names)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with its own or with other values."""
    rows, names = numbered(docs)
    leaks = decontaminate.find_leaks(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return renamed(docs, rows.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Orders all documents by Pfair slots towards weights that favour small sources; drops none.

    Adds the columns of mixing.mix() behind those of documents; a column of one of their names stays as `<name>_given`.
    """
    return mixing.mix(docs, mixing.flattened_weights(docs))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
]

#: No SQL for kernels, similarity joins and suffix orders: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
