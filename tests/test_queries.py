"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

import pactum.queries as Q

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_rows_equal(spark, duck, name):
    df = Q.QUERIES[name](spark, FOLDER)
    rel = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert all(KINDS.get(t, t) == types[c] for c, t in df.dtypes), (df.dtypes, types)
    mine = sorted((tuple(plain(r[c]) for c in rel.columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(Q.QUERIES.keys() - Q.SQL.keys()))
def test_others_run(spark, name):
    assert Q.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", ["cmp_group_idiom", "cmp_correlated_count", "cmp_join_equi", "cmp_join_theta", "rel_fan_in_count"])
def test_nested_scans_are_not_products(spark, name):
    plan = Q.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_order_does_not_depend_on_partitions(spark):
    df = Q.QUERIES["snk_diagnostics"](spark, FOLDER)
    assert [r.n for r in df.orderBy("n").collect()] == list(range(1, df.count() + 1))
