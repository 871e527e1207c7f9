"""Registered queries of the training-data operators: thin views on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.llm import class_lm, decontaminate, embedding_dedup, hard_negatives, html_text, jaccard_join, language_id, mixing, periodic_runs, suffix_dedup, toxicity, url_rules, warc
from isoweave.llm.shared import crc_mod, table
from isoweave.llm.sql import ORACLE_SQL as ORACLE_SQL

#: Curated (verdict, host and path) rules that every url is judged by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs, crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), size=5, threshold=0.8)


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mixing.mix(docs, mixing.flattened_weights(docs))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=100)


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(rows.withColumn("label", label)), F.col("vec_id") % 50 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(table(spark, sf_dir, "documents"), crc_mod("doc_id", 1 << 32))


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_embedding_near_dedup, op3_language_id, op4_warc_archive, op5_jaccard_join, op6_class_lm, op7_pfair_mixing, op8_suffix_dedup, op9_benchmark_leaks, op10_toxicity, op11_html_text, op12_hard_negatives, op13_periodic_runs)}
