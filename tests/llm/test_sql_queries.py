"""Registered corpus queries: against their SQL where they have one, else their shape."""

import duckdb
import pytest

from check import compare
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"
NATIVE = ("op1_", "op4_", "op10_")
COLUMNS = {
    "op2_": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_": ["page_id", "url", "text", "n_chars"],
    "op6_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op13_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op9_": ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("query", sorted(SQL))
def test_matches_sql(spark, duck, query):
    assert compare(QUERIES[query](spark, FOLDER).toPandas(), duck.execute(SQL[query]).df()) == ""


@pytest.mark.parametrize("query", [q for q in QUERIES if q.startswith(NATIVE)])
def test_native_operators_run_no_python(spark, query):
    plan = QUERIES[query](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("query", sorted(set(QUERIES) - set(SQL)))
def test_shape(spark, query):
    df = QUERIES[query](spark, FOLDER)
    want = next(v for k, v in COLUMNS.items() if query.startswith(k))
    assert df.columns[: len(want)] == want
    table = "pages" if query.startswith("op3_") else "documents"
    rows = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert df.count() >= rows if query.startswith("op9_") else df.count() == rows


def test_every_operator_is_registered():
    import __spark_entry__ as e

    found = set(e.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in found if q.startswith("op")}
    assert "pipeline" in found and set(SQL) <= set(e.oracle_sql())
