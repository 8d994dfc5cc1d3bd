"""Bloom filters, bounded ranks and dense numbers."""

import pytest
from pyspark.sql import functions as F

from claimlens.operators import filters, queueing, ranks, registry


def test_a_filter_loses_no_name(spark):
    names = spark.range(40_000).select(F.concat(F.lit("p"), F.col("id")).alias("package"))
    bloom = filters.bloom_filter(names)
    assert bloom[0].count() <= bloom[1]
    assert filters.maybe_in(names, bloom).where("not maybe").count() == 0
    others = spark.range(40_000, 80_000).select(F.concat(F.lit("p"), F.col("id")).alias("package"))
    assert filters.maybe_in(others, bloom).where("maybe").count() < 4_000
    none = filters.bloom_filter(names.limit(0))
    assert filters.maybe_in(names, none).where("maybe").count() == 0


def test_a_full_filter_is_still_exact(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_WORDS", 16)
    firsts = spark.range(3000).select(F.concat(F.lit("p"), F.col("id")).alias("package"), F.lit("s").alias("source_url"))
    log = spark.range(0, 3000, 2).select(F.concat(F.lit("p"), F.col("id")).alias("package"), F.when(F.col("id") % 3 == 0, 404).when(F.col("id") % 5 == 0, None).otherwise(200).alias("status"))
    got = {tuple(r) for r in filters.unclaimed_by_filter(firsts, log).collect()}
    assert got == {tuple(r) for r in registry.unclaimed(firsts, log).collect()} and 1500 < len(got) < 3000


def test_settled_names_are_not_shuffled(spark):
    firsts = spark.range(20_000).select(F.concat(F.lit("p"), F.col("id")).alias("package"), F.lit("s").alias("source_url"))
    marked = filters.maybe_in(firsts, filters.bloom_filter(firsts.where("package < 'p3'").select("package")))
    plan = marked.where(~F.col("maybe"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("k", [1, 3])
def test_least_of_groups(spark, k):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    got = ranks.least(rows, "g", k, "x", "id", salt="id")
    want = sorted((r.x, r.id) for r in rows.where("g = 'a'").collect())[:k]
    assert [(r.x, r.id, r.n) for r in got.where("g = 'a'").orderBy("n").collect()] == [(*p, i + 1) for i, p in enumerate(want)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3


def test_proxies_are_dealt_evenly(spark):
    sparse = spark.range(100).repartition(7).select((F.monotonically_increasing_id() * 2).alias("seq"))
    proxies = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "idx long, proxy string")
    got = queueing.round_robin(sparse, proxies).orderBy("seq").collect()
    assert [r.proxy for r in got] == [f"p{i % 3}" for i in range(100)] and got[0].asDict().keys() == {"seq", "proxy"}
    assert queueing.round_robin(sparse.limit(0), proxies).count() == 0
