"""Operator 4: a content-addressed WARC archive.

The archive is two tables. `payloads` keeps every distinct payload once under its digest;
`records` keeps the exact header bytes of every record. Joining the two by digest gives the
original records back. A digest counts only after it was recomputed from the stored bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoweave.llm.shared import hot_join, work_dir


@F.pandas_udf(T.StringType())
def base32(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else base64.b32encode(b).decode())


def sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1."""
    return base32(F.unhex(F.sha1(payload)))


def http_head(payload_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), payload_bytes.cast("string"), F.lit("\r\n\r\n"))


def warc_head() -> Column:
    """WARC/1.1 header of a row with page_id, url, record_type, payload_digest, refers_to and http.

    White space and control characters of a url are percent-encoded, so that none ends its header
    line; a null page_id is written as `null`.
    """
    c = F.col
    uri = F.coalesce(c("url"), F.lit(""))
    for code in (9, 10, 13, 32):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    uri = F.regexp_replace(uri, r"[\x00-\x1f\x7f]", "%1A")  # what is left counts as one, the substitute
    response = c("record_type") == "response"
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), c("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(c("page_id").cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), c("payload_digest"),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), c("refers_to").cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.when(response, c("payload_bytes")).otherwise(F.lit(0))).cast("string"),
        F.lit("\r\n\r\n"),
    )


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Writes `pages(page_id, url, html)` as folder/records and folder/payloads.

    Of the records whose payload is the same and has `least_bytes` bytes or more, the one with the
    smallest page_id is the response and the others revisit it. A null html is an empty payload, a
    null url an empty target. A null page_id is no response for others if a copy has an id; copies
    without any id are all responses. Long payloads are stored whole; an empty table gives empty
    archives. Further columns are ignored. Rows with one page_id and one payload are the same
    capture: each is a record, all with the same headers. Copies are found by SHA-1,
    SHA-256 and length together, and the payload bytes are shuffled once, not with the record rows.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    digests = [F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").cast("long").alias("payload_bytes")]
    same = ["sha1", "sha256", "payload_bytes"]
    slim = rows.select("page_id", "url", *digests)
    first = slim.groupBy(*same).agg(F.min("page_id").alias("first_id"))
    own = (F.col("payload_bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    records = (
        hot_join(slim, first, same, ["page_id", "url"])  # one payload may belong to a third of all pages
        .withColumn("record_type", F.when(own, "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~own, F.col("first_id")))
        .withColumn("payload_digest", base32(F.unhex("sha1")))
        .withColumn("http", http_head(F.col("payload_bytes")))
    )
    records.select(
        F.col("sha256").alias("store_key"),
        F.concat(warc_head(), "http").cast("binary").alias("header"),
    ).write.parquet(f"{folder}/records", compression="zstd")
    rows.select(digests[1], "payload").dropDuplicates(["sha256"]).withColumnRenamed("sha256", "store_key").write.parquet(f"{folder}/payloads", compression="zstd")


def read_headers(spark, folder: str) -> DataFrame:
    """One row for each record, read from its header bytes alone.

    Fields are read at the begin of a header line of their own, so a url can't pass for one.
    """
    text = F.col("header").cast("string")
    head = F.substring_index(text, "\r\n\r\n", 1)
    got = lambda name, pattern: F.regexp_extract(head, rf"\r\n{name}: {pattern}(?=\r\n|$)", 1)
    number = lambda c: F.when(c != "", c).try_cast("long")
    return spark.read.parquet(f"{folder}/records").select(
        "store_key", "header",
        number(got("WARC-Record-ID", r"<urn:page:(-?\d+)>")).alias("page_id"),
        got("WARC-Type", r"(\w+)").alias("record_type"),
        got("WARC-Target-URI", r"([^\r\n]*)").alias("url"),
        got("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("header_digest"),
        number(got("WARC-Refers-To", r"<urn:page:(-?\d+)>")).alias("refers_to"),
        number(got("Content-Length", r"(\d+)")).alias("block_bytes"),
        number(F.regexp_extract(F.substring_index(text, "\r\n\r\n", -2), r"\r\nContent-Length: (\d+)", 1)).alias("header_bytes"),
    )


def reconstruct(spark, folder: str) -> DataFrame:
    """The original records: header bytes and, for a response, the payload behind them.

    Columns: page_id, record_type, record (the whole record), payload (full, for revisits too).
    """
    joined = hot_join(read_headers(spark, folder), spark.read.parquet(f"{folder}/payloads"), ["store_key"], ["header"], spread=16)
    end = F.lit("\r\n\r\n").cast("binary")
    return joined.select("page_id", "record_type", "payload", F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")), end).alias("record"))


def read_archive(spark, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and verified for each record.

    Length and digests are taken anew from the stored bytes, once for each payload; `verified`
    says that they equal the store key and what the record's own header states, and that header and
    payload give a block of the length that the record states.
    """
    stored = spark.read.parquet(f"{folder}/payloads").select("store_key", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1(F.col("payload")).alias("payload_digest"), (F.sha2("payload", 256) == F.col("store_key")).alias("sound"))
    heads = read_headers(spark, folder)
    http = F.octet_length("header") - F.octet_length(F.substring_index(F.col("header").cast("string"), "\r\n\r\n", 1)) - 4
    held = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    return (
        hot_join(heads.withColumn("http_bytes", http).drop("header"), stored, ["store_key"], ["page_id", "url"])
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url",
                (F.col("sound") & (F.col("header_digest") == F.col("payload_digest")) & (F.col("header_bytes") == F.col("payload_bytes")) & (F.col("block_bytes") == F.col("http_bytes") + held)).alias("verified"))
    )


def export_files(spark, folder: str, target: str, compression: str = "gzip") -> None:
    """Plain .warc text files: every record is followed by two line breaks, as the format asks."""
    whole = reconstruct(spark, folder).select(F.expr("cast(substring(record, 1, octet_length(record) - 4) as string)").alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(target)


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in a stream of bytes; holds one record at a time."""
    held = b""
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            if len(held) < end + 4 + size + 4:
                break
            yield head, held[end + 4 : end + 4 + size]
            held = held[end + 8 + size :]


def new_folder(spark, name: str = "warc") -> str:
    import uuid

    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
