"""Every registered query of the training-data operators on whole small tables, against its SQL where there is one."""

import duckdb
import pytest

from isoweave.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLE = {"op1_url_rules": "pages", "op2_embedding_near_dedup": "embeddings", "op4_warc_archive": "pages", "op11_html_text": "pages"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(tuple, df.astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"}).values.tolist()))


def whole(df):
    """Ids with nulls come as floats on one side."""
    for c in df.columns:
        if df[c].dtype.kind == "f" and (df[c].dropna() % 1 == 0).all():
            df[c] = df[c].astype("Int64")
    return df


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(whole(QUERIES[name](spark, SF).toPandas())) == rows(whole(duck.execute(ORACLE_SQL[name]).df()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op9_benchmark_leaks"}))
def test_query_has_a_row_for_each_row_of_its_table(spark, duck, name):
    table = TABLE.get(name, "documents")
    key = "page_id" if table == "pages" else "doc_id"
    got = sorted(r[0] for r in QUERIES[name](spark, SF).select(key).collect())
    assert got == sorted(r[0] for r in duck.execute(f"select {key} from {table}").fetchall())


def test_leaks_query_finds_whole_items(spark, duck):
    """Every document that holds the words of an item one after the other, as they are or in lower case."""
    squeeze = lambda t: " ".join((t or "").lower().split())
    items = [(i, squeeze(t)) for i, t in duck.execute("select item_id, text from benchmark").fetchall()]
    docs = [(d, squeeze(t)) for d, t in duck.execute("select doc_id, text from documents").fetchall()]
    held = {(d, i) for d, t in docs for i, x in items if len(x.split()) >= 8 and x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_benchmark_leaks"](spark, SF).collect()}
    assert held and held <= got
