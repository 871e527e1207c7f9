"""The training-data operators can be taken out: nothing else imports them."""

import pathlib

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "isoweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert "isoweave.llm" not in p.read_text(), p


def test_entry_lists_queries(spark):
    import __spark_entry__ as e

    from isoweave.plans.queries import ORACLE_SQL, QUERIES

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
