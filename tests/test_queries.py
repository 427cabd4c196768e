"""Every query with SQL gives what the SQL gives."""

import math
import os

import duckdb
import pytest

from quaestor import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df, rel = plans.QUERIES[name](spark, DATA), duck.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_scored_requests_reads_whole_texts(spark):
    from quaestor.operators.generators import length_scores

    want = {r["doc_id"]: length_scores([r["text"]], [4])[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["logits"] for r in plans.QUERIES["scored_requests"](spark, DATA).collect()} == want


@pytest.mark.parametrize(("name", "rows"), [("gen_deadlines", "SELECT 4 * count(*) FROM orders"), ("catalog_distractors", "SELECT 5 * count(DISTINCT l_orderkey) FROM lineitem")])
def test_reads_all_orders(spark, duck, name, rows):
    assert plans.QUERIES[name](spark, DATA).count() == duck.sql(rows).fetchall()[0][0]
