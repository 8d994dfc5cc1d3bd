"""Rate control, queues, metrics and streams."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.operators import metrics, queueing, ratecontrol, registry
from claimlens.operators import references as refs
from claimlens.streaming import streams

START = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """rows: (event_id, seconds, host, job_id, status)"""
    return spark.createDataFrame([(e, START + dt.timedelta(seconds=s), h, j, x) for e, s, h, j, x in rows], "event_id long, ts timestamp_ntz, host string, job_id long, status int")


def replayed(rows, most):
    out = {}
    for e, s, h, _, x in sorted(rows, key=lambda r: (r[1], r[0])):
        out.setdefault(h, ratecontrol.HostReplay(most)).request(int((START - dt.datetime(1970, 1, 1)).total_seconds() + s) * 1_000_000, x, None)
    return {h: (r.rate, r.retries, r.until, r.discarded, r.sent, r.delayed, r.refused) for h, r in out.items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([2.3, 30.0]))
def test_final_state_is_the_replay(spark, seed, most):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(600), rng.choice("abc"), i, rng.choice([200, 200, 404, 429])) for i in range(rng.randrange(1, 200))]
    got = {r.host: tuple(r)[1:] for r in ratecontrol.host_state(log(spark, rows), most).collect()}
    assert got == replayed(rows, most)


def test_golden_state(spark):
    from claimlens.plans.queries import QUERIES

    row = QUERIES["rate_state_final"](spark, "/root/testdata/sf0.01").where("host = 'h0.example'").first()
    assert tuple(row)[1:] == (2.250995600000001, 6, 1704254105756565, True, 42, 0, 477)


def test_stream_ends_in_the_same_state(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i, rng.choice("ab"), i, rng.choice([200, 429, 503])) for i in range(120)]
    for k in range(3):  # later files hold later requests
        log(spark, rows[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = log(spark, rows[:1]).schema
    stream = streams.host_states(streams.file_stream(spark, str(tmp_path / "in"), schema, max_files=1))
    got = streams.drain(stream, str(tmp_path / "states"), str(tmp_path / "state"), "update")
    last = got.groupBy("host").agg(F.max_by(F.struct("*"), F.col("sent") + F.col("rejected")).alias("x")).select("x.*")
    assert {r.host: tuple(r)[1:] for r in last.collect()} == replayed(rows, 30.0)


def test_streamed_logs_come_in_bounded_batches(spark, monkeypatch):
    from pathlib import Path

    from claimlens.plans.queries import QUERIES
    from claimlens.session import shared_dir

    sf, top = "/root/testdata/sf0.001", Path(shared_dir(spark).removeprefix("file:"))
    one = QUERIES["stream_throughput"](spark, sf).where("n > 0").collect()
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    monkeypatch.setattr(streams, "FILE_ROWS", -(-n // 5), raising=False)
    monkeypatch.setattr(streams, "MAX_FILES", 1, raising=False)
    for name, want in (("stream_throughput", one), ("stream_rate_state", QUERIES["rate_state_final"](spark, sf).collect())):
        before = set(top.glob("stream-*"))
        assert sorted(map(tuple, QUERIES[name](spark, sf).where("sent > 0" if name == "stream_rate_state" else "n > 0").collect())) == sorted(map(tuple, want))
        (path,) = set(top.glob("stream-*")) - before
        sizes = [spark.read.parquet(str(f)).count() for f in path.glob("in/part-*")]
        assert sum(sizes) == n and max(sizes) < n / 2 and len(list(path.glob("out/batch=[0-9]*"))) >= 5


def test_stream_forms(spark, tmp_path):
    files = spark.createDataFrame([("u1", "require('aa') require('bb')", START), ("u2", "require('aa')", START + dt.timedelta(seconds=60))], "url string, body string, ts timestamp")
    files.write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), files.schema)
    assert {r.package for r in streams.drain(streams.new_packages(stream), str(tmp_path / "packages"), str(tmp_path / "c1")).collect()} == {"aa", "bb"}
    assert {r.package for r in streams.drain(streams.new_packages_within(stream, "ts", "1 hour"), str(tmp_path / "within"), str(tmp_path / "c2")).collect()} == {"aa", "bb"}
    ticks = streams.drain(streams.throughput(stream), str(tmp_path / "ticks"), str(tmp_path / "c3"))
    assert [(r.n, r.rps) for r in ticks.collect()] == [(1, 0.5)]
    streams.to_files(streams.new_packages(stream), str(tmp_path / "out"), str(tmp_path / "c4"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_transport_errors_change_nothing(spark):
    rows = log(spark, [(1, 0, "a", 1, 200), (2, 1, "a", 1, 429)]).withColumn("error", F.when(F.col("event_id") == 2, "reset"))
    assert ratecontrol.host_state(rows).first().rate == 2.2


def test_blocked_hosts(spark):
    rows = log(spark, [(1, 0, "a", 1, 429), (2, 1, "b", 1, 200)])
    at = int((START - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    assert [r.host for r in ratecontrol.blocked_at(rows, F.lit(at + 4_000_000)).collect()] == ["a"]
    assert ratecontrol.blocked_at(rows, F.lit(at + 4_000_001)).count() == 0
    assert ratecontrol.blocked_at(rows, F.lit(at - 1)).count() == 0


def test_token_bucket(spark):
    rows = [(i, 0, "a", i, 200) for i in range(4)]
    waits = [r.wait_us for r in ratecontrol.rate_trace(log(spark, rows)).orderBy("event_id").collect()]
    assert waits[:2] == [0, 0] and 0 < waits[2] < waits[3]


@pytest.mark.parametrize(("statuses", "want"), [([429, 200], (2, 200, "ok")), ([429, 429, 429, 503], (4, 503, "fail")), ([429] * 4 + [200], (4, 429, "exhausted")), ([429], (1, 429, "waiting")), ([404], (1, 404, "fail"))])
def test_retries(spark, statuses, want):
    rows = log(spark, [(i, i, "a", 7, s) for i, s in enumerate(statuses)])
    assert tuple(ratecontrol.retry_outcomes(rows).first())[1:] == want


def test_routes(spark):
    rows = spark.createDataFrame([(429, None), (200, None), (399, None), (400, None), (None, "reset")], "s int, e string")
    assert [r[0] for r in rows.select(ratecontrol.route(F.col("s"), F.col("e"))).collect()] == ["retry", "ok", "ok", "fail", "fail"]
    assert [r[0] for r in rows.select(registry.outcome(F.col("s"), F.col("e"))).collect()] == ["unknown", "claimed", "unknown", "unknown", "failed"]


def test_queues(spark):
    free = spark.createDataFrame([("a", 2), ("b", 0), ("c", 1), ("d", 4)], "host string, pending long")
    blocked = spark.createDataFrame([("d",)], "host string")
    assert {r.host for r in queueing.available(free, blocked).collect()} == {"a", "c"}
    assert [queueing.assigned(free, blocked, w).first().host for w in range(5)] == ["a", "c", "c", "a", "a"]
    assert queueing.random_host(free, blocked, 3).first() == queueing.random_host(free, blocked, 3).first()
    s = queueing.statistics(free, blocked).first()
    assert (s.total_domains, s.available_domains, s.blocked_domains, s.blocked_domain_list, s.domain_job_counts) == (4, 2, 1, ["d"], {"a": 2, "c": 1, "d": 4})
    assert {tuple(r) for r in queueing.by_host(free, blocked.union(spark.createDataFrame([("z",)], "host string"))).collect()} == {("a", 2, False, True), ("b", 0, False, False), ("c", 1, False, True), ("d", 4, True, False), ("z", 0, True, False)}
    queue = spark.createDataFrame([("d", i) for i in range(9)] + [("a", 1)], "host string, ord long")
    moved = queueing.redistributed(queue, blocked).collect()
    assert {(r.from_host, r.host) for r in moved} == {("d", None)} and sorted(r.ord for r in moved) == [0, 1, 2, 3, 4]
    assert queueing.redistributed(queue, blocked, None).count() == 9
    assert [r.ord for r in queueing.fifo(queue).where("host = 'd'").collect()] == list(range(9))
    assert spark.range(1).select(queueing.needs_refresh(F.lit(1), F.lit(6)), queueing.needs_refresh(F.lit(1), F.lit(5))).first()[:] == (True, False)


def test_ticks_and_progress(spark):
    rows = spark.createDataFrame([(0, 1), (1_000_000, 2), (7_000_000, 3)], "us long, event_id long")
    assert [(r.tick, r.n, r.rps) for r in metrics.ticks(rows).orderBy("tick").collect()] == [(0, 2, 1.0), (2, 0, 0.0), (4, 0, 0.0), (6, 1, 0.5)]
    assert metrics.ticks(rows.limit(0)).count() == 0
    got = metrics.progress(rows, 2, 0, block_s=3).orderBy("event_id").collect()
    assert [(r.current, r.percent) for r in got] == [(1, 50.0), (2, 100.0), (2, 100.0)]
    many = spark.range(500).select((F.col("id") * F.col("id") * 1000).alias("us"), (500 - F.col("id")).alias("event_id"))
    for block_s, cells in ((3600, 3600), (10, 3), (1, 1)):
        assert [r.current for r in metrics.progress(many, 500, 0, block_s=block_s, cells=cells).orderBy(F.desc("event_id")).collect()] == list(range(1, 501))


def test_requests_are_counted_and_observed(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([("FetchJS",), ("ProcessJS",), ("VerifyPackage",), ("FetchJS",)], "job_type string")
    assert metrics.requests(rows).first().n == 3 and metrics.requests(rows.limit(0)).first().n == 0
    seen = Observation("requests")
    assert metrics.counting(rows, seen).count() == 4 and seen.get == {"n": 3}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["require(", "'", '"', "`", "react", "@a/b", "import ", "{x}", " from ", ")", ";", "\n", "x", "/"]), max_size=12), max_size=30))
def test_pattern_agrees_with_re2(spark, parts):
    import duckdb

    from claimlens.functions.names import REFERENCE, regex_references

    texts = ["".join(p) for p in parts] or [""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, body string")
    ours = [r[0] for r in rows.orderBy("i").select(regex_references(F.col("body"))).collect()]
    assert ours == [duckdb.execute("SELECT regexp_extract_all(?, ?, 1)", [t, REFERENCE]).fetchone()[0] for t in texts]


def test_first_sources_and_findings(spark):
    files = spark.createDataFrame([(2, "u2", "require('aa')"), (1, "u1", "require('aa') require('bb')")], "page_id long, url string, body string")
    firsts = refs.first_sources(refs.references(files))
    assert {tuple(r) for r in firsts.collect()} == {("aa", "u1"), ("bb", "u1")}
    answers = spark.createDataFrame([("aa", 200), ("aa", 404), ("bb", 404)], "package string, status int")
    assert [r.unclaimed_package for r in registry.unclaimed(firsts, answers).collect()] == ["bb"]


def test_failed_lookups_are_no_findings(spark):
    firsts = spark.createDataFrame([(p, "s") for p in "abcdef"], "package string, source_url string")
    log = spark.createDataFrame([("a", 404, None), ("b", None, None), ("c", None, "timeout"), ("d", 404, "reset"), ("e", 200, None)], "package string, status int, error string")
    assert {r.unclaimed_package for r in registry.unclaimed(firsts, log).collect()} == {"a", "f"}
    assert {r.package: r.outcome for r in registry.outcomes(firsts, log).collect()} == {"a": "unclaimed", "b": "failed", "c": "failed", "d": "failed", "e": "claimed", "f": "unclaimed"}
    assert {r.unclaimed_package for r in registry.unclaimed(firsts, log.drop("error")).collect()} == {"a", "d", "f"}
    assert [r.package for r in registry.claimed(firsts, log).collect()] == ["e"]


@pytest.fixture
def many_blocks(spark):
    """Small logs are cut into as many blocks as large ones."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def traced(rows, most):
    out = {}
    hosts = {}
    for e, s, h, _, x in sorted(rows, key=lambda r: (r[1], r[0])):
        host = hosts.setdefault(h, ratecontrol.HostReplay(most))
        refused, at, wait = host.request(int((START - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000 + round(s * 1_000_000)), x, None)
        out[e] = (h, host.rate, host.retries, at, wait, refused, host.discarded)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.sampled_from([2.3, 30.0]), st.sampled_from([0.2, 1, 600]))
def test_the_trace_of_blocks_is_the_replay(spark, many_blocks, seed, most, span):
    rng = random.Random(seed)
    share = rng.choice([0.0, 0.01, 0.3])
    rows = [(i, round(rng.random() * span, 3) + (i // 100) * span, rng.choice("aaaab"), i, 429 if rng.random() < share else rng.choice([200, 404])) for i in range(rng.randrange(1, 400))]
    got = {r.event_id: tuple(r)[1:] for r in ratecontrol.rate_trace(log(spark, rows), most).collect()}
    want = traced(rows, most)
    assert {e: (*x[:4], *x[5:]) for e, x in got.items()} == {e: (*x[:4], *x[5:]) for e, x in want.items()}
    # A bucket that no block fills carries sums taken in another order.
    assert all(abs(got[e][4] - want[e][4]) <= 1 for e in want)


def test_one_busy_host_is_traced_by_many_tasks(spark, many_blocks):
    rows = spark.range(200_000).select(F.col("id").alias("event_id"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 10)).alias("ts"), F.lit("a").alias("host"), F.lit(200).alias("status"))
    blocks = ratecontrol._blocks(rows)
    sizes = sorted(r["count"] for r in blocks.groupBy("part").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 1.5 * sizes[0]
    got = ratecontrol.rate_trace(rows).agg(F.max("rate").alias("rate"), F.sum(F.col("wait_us")).alias("wait"), F.count("*").alias("n")).first()
    replay = ratecontrol.HostReplay(30.0)
    waits = sum(replay.request(100_000 * i, 200, None)[2] for i in range(2000))
    assert (got.rate, got.wait, got.n) == (30.0, waits, 200_000)
