from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from cadenza import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(str(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_range_reaches_the_scan(spark):
    plan = catalog.QUERIES["agg09_churn_transaction_behavior"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in plan and "Python" not in plan
