"""Every query against its SQL on the smallest tables; the driver's contract."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from claimlens.plans.oracle import SQL
from claimlens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def matches(spark, name, query, sql):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    got = query(spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    matches(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_golden_counts(spark):
    assert __spark_entry__.entry(spark).count() == 38
    assert {r.outcome: r.n for r in QUERIES["outcome_counts"](spark, SF).collect()} == {"claimed": 13, "unclaimed": 38, "unknown": 2, "failed": 9}


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
