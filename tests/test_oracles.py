"""Every registered query against its oracle, and the shape of every plan."""

import decimal
import re

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from marginalia.plans import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def clean(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    place = [columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(clean(r[i]) for i in place)) for r in cursor.fetchall())
    got = sorted(repr(tuple(clean(v) for v in r)) for r in df.collect())
    assert got and got == want


def test_every_query_is_checked():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("str", "snk0"))))
def test_plan_has_no_nested_loops_or_global_windows(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert not re.match(r"[^,]* (ASC|DESC)", spec), f"window without partition: {spec}"


def test_entry(spark):
    assert entry.entry(spark).count() == 40
