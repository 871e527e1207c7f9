"""Reads, votes, intervals and transcripts derived from the relational tables.

The SQL is valid in Spark and in DuckDB, so a query and its oracle see the same rows. All numbers
are whole, so sums are exact.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "orders", "lineitem", "events", "documents", "conversations", "part", "supplier", "nation", "region")

SQL = {
    # weighted votes for positions of reads, one shard for each return flag
    "votes": """SELECT l_suppkey AS id, CAST(l_partkey % 200 AS INT) AS pos, l_returnflag AS shard, CAST(l_quantity AS DOUBLE) AS weight,
        CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN 'C' WHEN 3 THEN 'G' WHEN 4 THEN 'T' WHEN 5 THEN 'Del' WHEN 6 THEN 'AC' ELSE 'GT' END AS allele FROM lineitem""",
    "backbone": """SELECT id, pos, substr('ACGT', pos % 4 + 1, 1) AS allele, CAST(1.5 AS DOUBLE) AS weight
        FROM (SELECT DISTINCT l_suppkey AS id, CAST(l_partkey % 200 AS INT) AS pos FROM lineitem) b""",
    "tallied": """SELECT id, pos, allele, sum(weight) AS weight
        FROM (SELECT id, pos, allele, weight FROM {votes} UNION ALL SELECT id, pos, allele, weight FROM {backbone}) v GROUP BY id, pos, allele""",
    # intervals
    "intervals": """SELECT CAST(l_suppkey % 8 AS INT) AS chr, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand,
        CAST(l_partkey * 50 + l_linenumber * 7 AS BIGINT) AS s, CAST(l_partkey * 50 + l_linenumber * 7 + l_quantity AS BIGINT) AS e FROM lineitem""",
    # transcripts: the lines of an order are exons
    "exons": """SELECT o_orderkey AS tx, CAST(o_custkey % 8 AS INT) AS chr, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand,
        CAST((o_custkey % 500) * 2000 + l_linenumber * 200 + p % 3 AS BIGINT) AS s, CAST((o_custkey % 500) * 2000 + l_linenumber * 200 + 90 + q % 5 AS BIGINT) AS e
        FROM orders JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) x ON o_orderkey = l_orderkey""",
    "junctions": """SELECT * FROM (SELECT tx, chr, strand, e AS "left", lead(s) OVER (PARTITION BY tx ORDER BY s) AS "right" FROM {exons}) j WHERE "right" IS NOT NULL""",
    "spans": "SELECT tx, chr, strand, min(s) AS tx_start, max(e) AS tx_end, count(*) AS n_exon FROM {exons} GROUP BY tx, chr, strand",
    "supported": 'SELECT chr, strand, "left", "right", count(*) AS n FROM {junctions} GROUP BY chr, strand, "left", "right"',
    # known junctions with scores
    "known": """SELECT chr, strand, "left", "right", CAST(n * 10 AS DOUBLE) AS score FROM {supported} WHERE ("left" + "right") % 5 = 0""",
    # peaks and coverage
    "peaks": """SELECT CAST(user_id % 8 AS INT) AS chr, CASE WHEN event_type = 'click' THEN '+' ELSE '-' END AS strand, CAST((event_id * 97) % 1000000 AS BIGINT) AS "start",
        CAST((event_id * 97) % 1000000 + 5 + user_id % 9 AS BIGINT) AS "end", CAST(floor(value) AS DOUBLE) AS score, event_id AS line_no FROM events""",
    "coverage": """SELECT CAST(user_id % 8 AS INT) AS chr, CAST((event_id * 131) % 1000000 AS BIGINT) AS "start", CAST((event_id * 131) % 1000000 + 20 + user_id % 30 AS BIGINT) AS "end",
        CAST(floor(value) AS DOUBLE) AS value, event_id AS line_no FROM events""",
    # coverage that goes on for some while, on both strands
    "deep": """SELECT chr, CASE WHEN "start" % 2 = 0 THEN '+' ELSE '-' END AS strand, "start", CASE WHEN "start" % 7 = 0 THEN "start" + 1500 ELSE "end" END AS "end", value, line_no FROM {coverage}""",
    "borders": """SELECT chr, strand, pos, sum(score) AS score FROM (SELECT chr, strand, "left" AS pos, score FROM {known} UNION ALL SELECT chr, strand, "right" AS pos, score FROM {known}) b GROUP BY chr, strand, pos""",
    # sequences: letters of the documents as bases
    "sequences": """SELECT doc_id AS id, translate(replace(replace(text, ' ', ''), chr(10), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzéèêçäöüßñóíÉÈÊÇÄÖÜÑÓÍ', 'ACGTACGTACGTACGTACGTACGTANACGTACGTACGTACGTACGTACGTANNNNNNNNNNNNNNNNNNNNNN') AS seq FROM documents""",
    # wells and reads
    "wells": "SELECT CAST(c_custkey AS BIGINT) AS zmw, CASE WHEN c_acctbal > 2000 THEN 1 ELSE 0 END AS productive, CAST(c_nationkey % 3 AS INT) + 1 AS movie FROM customer",
    "subreads": "SELECT o_custkey AS zmw, o_orderkey AS read_id, CAST(o_custkey % 3 AS INT) + 1 AS movie FROM orders WHERE o_orderstatus <> 'P'",
    "consensus": "SELECT o_custkey AS zmw, CAST(o_orderkey % 3 AS INT) + 1 AS movie FROM orders WHERE o_orderstatus = 'P'",
}


#: Tables that are dealt by a column first, so that grouping and joining by it shuffle them once.
DEALT = {"exons": {"lineitem": "l_orderkey"}}


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def oracle(sql: str) -> str:
    """A query over {inputs} as one DuckDB statement."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in names_in(SQL[name]):
            need(x)
        if name not in order:
            order.append(name)

    for n in names_in(sql):
        need(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"v_\1", s)
    head = ", ".join(f"v_{n} AS ({plain(SQL[n])})" for n in order)
    if not head:
        return plain(sql)
    own = re.match(r"WITH (RECURSIVE )?", sql)
    return f"WITH {own[1] or ''}{head}, {plain(sql[own.end():])}" if own else f"WITH {head} {plain(sql)}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived inputs, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name].replace('"', "`")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"(?:FROM|JOIN) {t}\b", text)}
    used |= {t: used[t].repartition(c) for t, c in DEALT.get(name, {}).items()}
    text = re.sub(rf"(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text)
    return spark.sql(text, **used, **{n: load(spark, sf_dir, n) for n in names_in(SQL[name])})
