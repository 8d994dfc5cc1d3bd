"""Streams: findings with late and repeated answers, first sources and their corrections, timers, idle ticks, order."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from claimlens.operators import metrics, ratecontrol
from claimlens.streaming import findings, streams

START = dt.datetime(2024, 1, 1)
FILES = "page_id long, url string, body string, ts timestamp"
ANSWERS = "package string, status int, error string, ts timestamp"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def files(spark, rows):
    return spark.createDataFrame([(i, f"u{i}", " ".join(f"require('{n}')" for n in names), at(m)) for i, m, *names in rows], FILES)


def answers(spark, rows):
    return spark.createDataFrame([(p, s, e, at(m)) for m, p, s, e in rows], ANSWERS)


class Found:
    """Two streams that grow batch by batch, and what has been put out so far."""

    def __init__(self, spark, path, **args):
        self.spark, self.path, self.args = spark, str(path), args

    def step(self, file_rows=(), answer_rows=()):
        for name, rows, make, schema in (("files", file_rows, files, FILES), ("answers", answer_rows, answers, ANSWERS)):
            os.makedirs(f"{self.path}/{name}", exist_ok=True)
            if rows:
                make(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")
        opened = [streams.file_stream(self.spark, f"{self.path}/{n}", s) for n, s in (("files", FILES), ("answers", ANSWERS))]
        out = streams.drain(findings.findings(*opened, **self.args), f"{self.path}/out", f"{self.path}/state")
        return sorted((r.package, r.page_id) for r in out.collect())


def test_findings_wait_for_late_and_repeated_answers(spark, tmp_path):
    found = Found(spark, tmp_path, wait="30 minutes", delay="10 minutes")
    # gone and twice are answered 404, mixed both 404 and 200, late by an answer that comes batches after its time, lost one that comes too late, silent never.
    assert found.step([(1, 0, "gone", "mixed"), (2, 1, "late", "silent", "twice"), (3, 2, "lost", "gone")], [(1, "gone", 404, None), (2, "mixed", 404, None)]) == []
    assert found.step([(4, 12, "other")], [(3, "mixed", 200, None), (5, "twice", 404, None), (6, "twice", 404, None), (12, "none", 200, None)]) == []
    assert found.step([(5, 20, "other")], [(11, "late", 200, None), (12, "other", 404, "reset"), (22, "none", 200, None)]) == []
    # The watermark passes the end of what the first files wait for.
    got = found.step([(6, 90, "end one")], [(90, "no name", 200, None)])
    assert got == [("gone", 1), ("gone", 3), ("lost", 3), ("silent", 2), ("twice", 2)]
    # lost's answer is older than the watermark, so it changes nothing, and what came out stays.
    assert found.step([(7, 95, "x1")], [(3, "lost", 200, None)]) == got


def test_findings_that_answers_have_to_tell(spark, tmp_path):
    found = Found(spark, tmp_path, wait="30 minutes", delay="10 minutes", answered=True)
    found.step([(1, 0, "gone", "mixed", "silent")], [(1, "gone", 404, None), (2, "mixed", 404, None), (3, "mixed", 200, None), (4, "gone", 404, None)])
    got = found.step([(2, 200, "end one")], [(200, "no name", 200, None)])
    assert set(got) == {("gone", 1)}


def test_findings_agree_with_batch_tables(spark):
    f, a = files(spark, [(1, 0, "gone", "mixed"), (2, 1, "gone")]), answers(spark, [(1, "mixed", 200, None), (2, "gone", 404, None)])
    assert {(r.package, r.page_id) for r in findings.findings(f, a).collect()} == {("gone", 1), ("gone", 2)}


def test_first_sources_are_corrected(spark, tmp_path):
    def make(s):
        return findings.first_sources_so_far(s)

    rows = [("aa", 9, 0, "u9"), ("bb", 5, 1, "u5b"), ("bb", 5, 0, "u5a")], [("aa", 9, 1, "u9"), ("aa", 4, 2, "u4"), (None, 1, 1, "x")], [("aa", 6, 0, "u6"), ("bb", 2, 7, "u2"), ("cc", 1, 0, None)]
    parts = [spark.createDataFrame(x, findings.SOURCE).repartition(2) for x in rows]
    out = streams.replay(parts, str(tmp_path), make, "update")
    assert sorted((r.package, r.page_id, r.pos, r.source_url, r.corrects) for r in out.collect()) == [
        ("aa", 4, 2, "u4", True), ("aa", 9, 0, "u9", False), ("bb", 2, 7, "u2", True), ("bb", 5, 0, "u5a", False), ("cc", 1, 0, None, False),
    ]
    assert {tuple(r) for r in findings.latest_sources(out).collect()} == {("aa", "u4"), ("bb", "u2"), ("cc", None)}


LOG = "event_id long, ts timestamp_ntz, host string, status int, error string"


def log(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(seconds=s), h, x, e) for i, (s, h, x, e) in enumerate(rows)], LOG)


def test_timers_free_and_forget_hosts(spark, tmp_path):
    first = log(spark, [(0, "a", 429, None), (1, "a", 429, None), (2, "b", 200, None)])
    second = log(spark, [(60, "b", 200, None)])
    third = log(spark, [(500, "c", 200, None)])
    fourth = log(spark, [(501, "a", 200, None)])
    out = streams.replay([first, second, third, fourth], str(tmp_path), lambda s: streams.host_events(s, idle_s=300), "update").collect()
    told = {e: sorted((r.host, r.retry_counter, r.sent) for r in out if r.event == e) for e in ("batch", "free", "idle")}
    assert told["free"] == [("a", 2, 2)] and told["idle"] == [("a", 2, 2), ("b", 0, 2)]
    # Forgotten, so a begins anew.
    assert told["batch"] == [("a", 0, 1), ("a", 2, 2), ("b", 0, 1), ("b", 0, 2), ("c", 0, 1)]


def test_state_shrinks_when_hosts_are_forgotten(spark, tmp_path):
    parts = [log(spark, [(100 * k, f"h{k}-{i}", 200, None) for i in range(40)]) for k in range(4)]
    kept = {}
    for idle in (None, 50):
        path = tmp_path / str(idle)
        seen = []

        def make(s, idle=idle):
            return streams.host_events(s, idle_s=idle)

        for part in parts:
            part.write.mode("append").parquet(f"{path}/in")
            with streams._keyed_store(spark):
                q = make(streams.file_stream(spark, f"{path}/in", part.schema)).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
                q.awaitTermination()
            seen.append(max(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
        kept[idle] = seen
    assert kept[None][-1] >= 160 > kept[50][-1]


def test_errors_change_no_rate_in_the_stream(spark, tmp_path):
    rows = log(spark, [(0, "a", 200, None), (1, "a", 200, "reset"), (2, "a", None, "timeout"), (3, "a", 429, None), (4, "b", 200, None)])
    got = streams.replay([rows], str(tmp_path), streams.host_states, "update")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in ratecontrol.host_state(rows).collect()}


def test_equal_times_in_two_batches_are_kept(spark, tmp_path):
    parts = [log(spark, [(7, "a", 200, None)] * 3), log(spark, [(7, "a", 429, None)] * 2)]
    got = streams.replay(parts, str(tmp_path), streams.host_states, "update").orderBy("sent").collect()
    assert [(r.sent, r.retry_counter) for r in got] == [(3, 0), (5, 2)]


def test_idle_ticks_come_from_the_stream(spark, tmp_path):
    def events(*seconds):
        return spark.createDataFrame([(i, START + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)], "event_id long, ts timestamp")

    parts = [events(1, 1.5, 9), events(12, 13, 31), events(33, 100)]
    last = streams.beat(parts[0], F.lit(START + dt.timedelta(seconds=112)).cast("timestamp"))
    got = streams.replay(parts, str(tmp_path), streams.ticks, "append", last).orderBy("tick").collect()
    base = int(START.replace(tzinfo=dt.UTC).timestamp())
    every = spark.createDataFrame([(int(s * 10**6),) for s in (1, 1.5, 9, 12, 13, 31, 33, 100)], "us long")
    assert [(r.tick - base, r.n, r.rps) for r in got] == [tuple(r) for r in metrics.ticks(every).orderBy("tick").collect()]


def test_order_needs_no_file_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    monkeypatch.setattr(streams, "MAX_FILES", 2)
    rows = spark.range(95).withColumn("x", 95 - F.col("id"))
    parts = streams.in_order(rows.repartition(3), str(tmp_path / "o"), "x")
    held = [[r.x for r in p.collect()] for p in parts]
    assert len(parts) == 5 and sorted(x for p in held for x in p) == list(range(1, 96)) and all(max(a) < min(b) for a, b in zip(held, held[1:], strict=False))
    one = streams.in_order(rows.limit(0), str(tmp_path / "empty"), "x")
    assert sum(p.count() for p in one) == 0


@pytest.mark.parametrize("name", ["stream_findings", "stream_first_source"])
def test_streamed_queries_run_without_rows(spark, tmp_path, name):
    from claimlens.plans.queries import QUERIES

    for t in ("pages", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
