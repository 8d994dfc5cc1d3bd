"""Adaptive rate control of hosts, replayed over a fetch log (event_id, ts, host, status[, error]).

A host's log is replayed by (ts, event_id). A rejection (429) cuts its rate and
starts a backoff; the sixth evicts the host and later requests are refused; any
other answer raises the rate; a transport error changes nothing.

The final state needs no replay of whole logs. Only a host's first six
rejections move its backoff, and between two of them a rate rises a bounded
number of times before it meets the maximum. So each host's rejections are found
with partial results (six a partition at most), every event is placed between
them by a join that AQE may split, and counts by segment are folded in the JVM:
a host that holds a third of all events is a group of seven counters. The trace
gives a row for each event: hosts' logs are cut into blocks, whose composed maps
are scanned, so that blocks of one host are worked on side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.measures import BURST, CUT, EVICTION, FLOOR, INITIAL_RATE, MOST_BACKOFF, RAISE, backoff_seconds, cut, micros, raised
from claimlens.operators.ranks import least
from claimlens.session import stage

REJECTED = 429
SEGMENTS = EVICTION + 2


def _events(log: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in log.columns else F.lit(None).cast("string")
    us = micros(F.col("ts")) if dict(log.dtypes)["ts"].startswith("timestamp") else F.col("ts").cast("bigint")
    return log.select("event_id", us.alias("us"), "host", F.col("status").cast("int").alias("status"), error.alias("error"))


def _rejections(events: DataFrame) -> DataFrame:
    """(host, marks): the first six rejections of each host in order, with the end of the backoff that each starts."""
    hit = events.where((F.col("status") == REJECTED) & F.col("error").isNull()).select("host", "us", "event_id")
    few = least(hit, "host", EVICTION + 1, "us", "event_id", salt="event_id")
    marks = few.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("us", "event_id"))).alias("m"))

    def step(done: Column, m: Column) -> Column:
        before = F.when(F.size(done) > 0, F.element_at(done, -1)["next"]).otherwise(F.lit(0).cast("bigint"))
        until = F.greatest(m["us"], before) + backoff_seconds(F.size(done) + 1) * 1_000_000
        return F.concat(done, F.array(F.struct(m["us"].alias("us"), m["event_id"].alias("event_id"), until.alias("next"))))

    start = F.filter(F.transform("m", lambda m: F.struct(m["us"].alias("us"), m["event_id"].alias("event_id"), m["us"].alias("next"))), lambda m: F.lit(False))
    return marks.select("host", F.aggregate("m", start, step).alias("marks"))


def placed(log: DataFrame) -> DataFrame:
    """Every event with segment (rejections of its host before it, up to six), rejected (refused) and delayed."""
    events = _events(log)
    rows = events.join(_rejections(events), "host", "left")
    marks = F.coalesce("marks", F.expr("cast(array() as array<struct<us:bigint,event_id:bigint,next:bigint>>)"))
    before = F.filter(marks, lambda m: (m["us"] < F.col("us")) | ((m["us"] == F.col("us")) & (m["event_id"] < F.col("event_id"))))
    segment = F.size(before)
    until = F.when(segment > 0, F.element_at(before, -1)["next"]).otherwise(F.lit(0).cast("bigint"))
    rows = rows.select("event_id", "us", "host", "status", "error", segment.alias("segment"), until.alias("until"))
    refused = F.col("segment") > EVICTION
    return rows.withColumns({"rejected": refused, "delayed": ~refused & (F.col("us") < F.col("until")), "effective_us": F.greatest("us", "until")})


def host_state(log: DataFrame, max_rate: float = 30.0) -> DataFrame:
    """host, rate, retry_counter, next_attempt_us, discarded, sent, delayed and rejected after the whole log."""
    rows = placed(log)
    good = ~F.col("rejected") & (F.col("status") != REJECTED) & F.col("error").isNull()
    hit = ~F.col("rejected") & (F.col("status") == REJECTED) & F.col("error").isNull()
    sums = rows.groupBy("host").agg(
        *[F.count(F.when(good & (F.col("segment") == i), 1)).alias(f"s{i}") for i in range(SEGMENTS)],
        F.count(F.when(hit, 1)).cast("int").alias("retry_counter"),
        F.count(F.when(~F.col("rejected"), 1)).alias("sent"),
        F.count(F.when(F.col("delayed"), 1)).alias("delayed"),
        F.count(F.when(F.col("rejected"), 1)).alias("rejected"),
        F.max(F.when(hit, F.col("effective_us") + backoff_seconds(F.col("segment") + 1) * 1_000_000)).alias("next_attempt_us"),
    )
    # More rises than this end at the maximum anyway.
    most = int(max_rate / RAISE) + 2
    rises = F.array(*[F.least(F.col(f"s{i}"), F.lit(most)).cast("int") for i in range(SEGMENTS)])
    seen = F.slice(rises, F.lit(1), F.col("retry_counter") + 1)

    def segment(rate: Column, n: Column, i: Column) -> Column:
        start = F.when(i > 0, cut(rate)).otherwise(rate)
        return F.aggregate(F.array_repeat(F.lit(0), n), start, lambda r, _: raised(r, max_rate))

    indexed = F.transform(seen, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    rate = F.aggregate(indexed, F.lit(INITIAL_RATE), lambda r, x: segment(r, x["n"], x["i"]))
    return sums.select("host", rate.alias("rate"), "retry_counter", F.coalesce("next_attempt_us", F.lit(0)).cast("bigint").alias("next_attempt_us"), (F.col("retry_counter") > EVICTION).alias("discarded"), "sent", "delayed", "rejected")


def discarded_hosts(log: DataFrame) -> DataFrame:
    return host_state(log).where("discarded").select("host", "retry_counter")


def rejected_requests(log: DataFrame) -> DataFrame:
    """Requests that an evicted host refuses at once."""
    return placed(log).where("rejected").select("event_id", "host")


def blocked_at(log: DataFrame, moment_us: Column) -> DataFrame:
    """Hosts that are in backoff at a moment, with its end: the log up to then decides."""
    past = _events(log).where(F.col("us") <= moment_us)
    marks = _rejections(past).select("host", F.element_at("marks", -1)["next"].alias("next_attempt_us"))
    return marks.where(F.col("next_attempt_us") >= moment_us)


class HostReplay:
    """The state of one host, moved on by one request at a time."""

    def __init__(self, max_rate: float, state: tuple | None = None):
        self.max_rate = max_rate
        self.rate, self.retries, self.until, self.sent, self.delayed, self.refused, self.tokens, self.last = state or (INITIAL_RATE, 0, 0, 0, 0, 0, float(BURST), None)

    def state(self) -> tuple:
        return (self.rate, self.retries, self.until, self.sent, self.delayed, self.refused, self.tokens, self.last)

    @property
    def discarded(self) -> bool:
        return self.retries > EVICTION

    def request(self, us: int, status: int | None, error: str | None) -> tuple[bool, int, int]:
        """Whether it is refused; else when it is let through, and how long the token bucket holds it, in microseconds."""
        if self.discarded:
            self.refused += 1
            return True, us, 0
        at = max(us, self.until)
        self.delayed += us < self.until
        self.sent += 1
        since = 0 if self.last is None else max(0, at - self.last)
        self.tokens = min(float(BURST), self.tokens + since / 1e6 * self.rate)
        wait = 0 if self.tokens >= 1 else int((1 - self.tokens) / self.rate * 1e6)
        self.tokens, self.last = self.tokens - 1, max(at, self.last or at)
        if error is None and status == REJECTED:
            self.rate = max(self.rate * CUT, FLOOR)
            self.retries += 1
            self.until = at + min(2 << min(self.retries, 30), MOST_BACKOFF) * 1_000_000
        elif error is None:
            self.rate = min(self.rate + RAISE, self.max_rate)
        return False, at, wait


_OUT = "event_id long, host string, rate double, retry_counter int, effective_us long, wait_us long, rejected boolean, discarded boolean"


def _most_rises(max_rate: float) -> int:
    """More rises than this end at the maximum anyway, from any rate that stands before them."""
    return int(max_rate / RAISE) + 2


def _blocks(log: DataFrame) -> DataFrame:
    """Placed events with `part`, the block that each stands in: ranges of (host, us, event_id), so that a busy host has many."""
    order = ("host", "us", "event_id")
    rows = placed(log).repartitionByRange(*order)
    return stage(rows.withColumn("part", F.spark_partition_id()), "rate-blocks")


def _entries(blocks: DataFrame) -> DataFrame:
    """For each block of a host: rises before it in each segment, the latest moment before it, and whether the host goes on.

    A rise is x -> min(x + 0.2, max), a cut x -> max(0.7 x, 0.1). Chains of such
    clamped affine maps are composed by counting: a segment, the stretch between two
    cuts, is a power of one rise, and at most six cuts take effect. So what a block
    does is seven counts, blocks are scanned by adding them up, and the rate that
    results is the same to the last bit as that of a replay. One row a block.
    """
    good = ~F.col("rejected") & (F.col("status") != REJECTED) & F.col("error").isNull()
    let_through = F.when(~F.col("rejected"), F.col("effective_us"))
    sums = blocks.groupBy("host", "part").agg(*[F.count(F.when(good & (F.col("segment") == i), 1)).alias(f"s{i}") for i in range(SEGMENTS)], F.max(let_through).alias("latest"), F.count("*").alias("n"))
    before = Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("host")
    counts = [F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)) for i in range(SEGMENTS)]
    totals = [F.sum(f"s{i}").over(every) for i in range(SEGMENTS)]
    return sums.select("host", "part", F.array(*counts).alias("before"), F.array(*totals).alias("totals"), F.max("latest").over(before).alias("latest_before"), F.count("*").over(every).alias("n_blocks"))


def segment_rates(totals: list[int], max_rate: float) -> list[np.ndarray]:
    """For each segment the rates after 0, 1, ... rises in it; a segment begins where the one before ends, cut."""
    out, rate, most = [], INITIAL_RATE, _most_rises(max_rate)
    for i, n in enumerate(totals):
        rates = [rate if i == 0 else max(rate * CUT, FLOOR)]
        for _ in range(min(int(n), most)):
            rates.append(min(rates[-1] + RAISE, max_rate))
        out.append(np.array(rates))
        rate = rates[-1]
    return out


def _rated(rows: pa.Table, max_rate: float) -> dict[str, np.ndarray]:
    """A block's events in order with the rates before and after each, from the counts that stand before the block."""
    rows = rows.sort_by([("us", "ascending"), ("event_id", "ascending")])
    segment, rejected = np.asarray(rows.column("segment")), np.asarray(rows.column("rejected"))
    status = np.asarray(rows.column("status").combine_chunks().fill_null(-1))
    answered = np.asarray(rows.column("error").combine_chunks().is_null())
    # A row without status raises nothing, as it compares with nothing.
    good = ~rejected & answered & (status != REJECTED) & (status != -1)
    hit = ~rejected & answered & (status == REJECTED)
    before = rows.column("before")[0].as_py()
    rates = segment_rates(rows.column("totals")[0].as_py(), max_rate)
    old, new = np.empty(len(segment)), np.empty(len(segment))
    for i in np.unique(segment):
        own = segment == i
        done = before[i] + np.cumsum(good[own])
        last = len(rates[i]) - 1
        new[own] = rates[i][np.minimum(done, last)]
        old[own] = rates[i][np.minimum(done - good[own], last)]
        # The cut that ends a segment belongs to the event that makes it.
        cut_here = own & hit
        new[cut_here] = rates[i + 1][0] if i + 1 < len(rates) else np.maximum(old[cut_here] * CUT, FLOOR)
    at = np.asarray(rows.column("effective_us"))
    return {"rows": rows, "old": old, "new": new, "at": at, "hit": hit, "rejected": rejected, "segment": segment, "latest": rows.column("latest_before")[0].as_py()}


def _bucket_steps(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """What flows into the bucket before each request that is let through, and where those are."""
    let = np.flatnonzero(~x["rejected"])
    at = x["at"][let]
    first = x["latest"]
    latest = np.maximum.accumulate(np.append(at[:1] if first is None else [max(first, 0)], at))[:-1] if len(at) else at
    return np.maximum(0, at - latest) / 1e6 * x["old"][let], let


def _bucket_map(max_rate: float):
    """Of a block: its bucket x -> x + flow, unless that would have met the brim; then `full`, what a full bucket ends with."""

    def run(table: pa.Table) -> pa.Table:
        x = _rated(table, max_rate)
        flow, _ = _bucket_steps(x)
        tokens, total, least = float(BURST), 0.0, math.inf
        for c in flow.tolist():
            tokens = min(float(BURST), tokens + c) - 1
            total += c
            least = min(least, BURST - total)  # a bucket with more than this meets the brim here
            total -= 1
        values = [table.column("host")[0].as_py(), table.column("part")[0].as_py(), total, least, tokens]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["host", "part", "flow", "least", "full"])

    return run


def _traced(max_rate: float):
    def run(table: pa.Table) -> pa.Table:
        x = _rated(table, max_rate)
        flow, let = _bucket_steps(x)
        wait = np.zeros(len(x["at"]), np.int64)
        tokens = table.column("tokens")[0].as_py()
        held = []
        for c, rate in zip(flow.tolist(), x["old"][let].tolist(), strict=True):
            tokens = min(float(BURST), tokens + c)
            held.append(0 if tokens >= 1 else int((1 - tokens) / rate * 1e6))
            tokens -= 1
        wait[let] = held
        retries = np.minimum(x["segment"] + x["hit"], EVICTION + 1).astype(np.int32)
        at = np.where(x["rejected"], np.asarray(x["rows"].column("us")), x["at"])
        columns = (x["rows"].column("event_id"), x["rows"].column("host"), pa.array(x["new"]), pa.array(retries), pa.array(at), pa.array(wait), pa.array(x["rejected"]), pa.array(retries > EVICTION))
        return pa.table(list(columns), names=["event_id", "host", "rate", "retry_counter", "effective_us", "wait_us", "rejected", "discarded"])

    return run


def _buckets(rows: DataFrame, max_rate: float) -> DataFrame:
    """(h, p, tokens): what a host's bucket holds where each of its blocks begins, for hosts with several."""
    maps = rows.where("n_blocks > 1").groupBy("host", "part").applyInArrow(_bucket_map(max_rate), "host string, part int, flow double, least double, full double")
    earlier = F.sort_array(F.collect_list(F.struct("part", "flow", "least", "full")).over(Window.partitionBy("host").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    fold = F.aggregate("earlier", F.lit(float(BURST)), lambda x, m: F.when(x > m["least"], m["full"]).otherwise(x + m["flow"]))
    return stage(maps.withColumn("earlier", earlier).select(F.col("host").alias("h"), F.col("part").alias("p"), fold.alias("tokens")), "rate-buckets")


def rate_trace(log: DataFrame, max_rate: float = 30.0) -> DataFrame:
    """Each event with the state after it and the token bucket's wait.

    A host's log is cut into blocks, which tasks work on side by side: what stands
    before a block comes from a scan over the blocks' composed maps (see _entries;
    a bucket's map is x -> min(x + flow, full), composed the same way). Rates are
    those of a replay to the last bit, waits too unless a host's bucket is never full
    over a whole block; then sums are taken in another order.
    """
    blocks = _blocks(log)
    entries = stage(_entries(blocks), "rate-entries")
    rows = blocks.join(entries, (blocks["host"].eqNullSafe(entries["host"])) & (blocks["part"] == entries["part"])).select(blocks["*"], "before", "totals", "latest_before", "n_blocks")
    known = rows.withColumn("tokens", F.lit(float(BURST)))
    if entries.where("n_blocks > 1").limit(1).count():
        tokens = _buckets(rows, max_rate)
        known = rows.join(tokens, rows["host"].eqNullSafe(tokens["h"]) & (rows["part"] == tokens["p"]), "left").select(rows["*"], F.coalesce("tokens", F.lit(float(BURST))).alias("tokens"))
    return known.groupBy("host", "part").applyInArrow(_traced(max_rate), _OUT)


def retry_outcomes(log: DataFrame, attempts: int = 4) -> DataFrame:
    """For each job: the first answer other than 429 among its first attempts, or that it ran out of them.

    A job with any number of rows is ranked in parts, of which each leaves its first attempts.
    """
    rows = least(log, "job_id", attempts, "ts", "event_id", salt="event_id").withColumnRenamed("n", "attempt")
    answered = F.col("status") != REJECTED
    found = rows.groupBy("job_id").agg(F.min(F.when(answered, F.col("attempt"))).alias("at"), F.min_by("status", F.when(answered, F.col("attempt"))).alias("status"), F.max("attempt").alias("last"))
    state = F.when(F.col("at").isNull() & (F.col("last") >= attempts), "exhausted").when(F.col("at").isNull(), "waiting").when(F.col("status") < 400, "ok").otherwise("fail")
    return found.select("job_id", F.coalesce("at", "last").cast("bigint").alias("attempts"), F.when(F.col("at").isNotNull(), F.col("status")).otherwise(REJECTED).cast("bigint").alias("status"), state.alias("outcome"))


def route(status: Column, error: Column | None = None) -> Column:
    """What happens to a fetch: tried again, failed, or read."""
    failed = (status >= 400) if error is None else (error.isNotNull() | (status >= 400))
    return F.when(status == REJECTED, F.lit("retry")).when(failed, F.lit("fail")).otherwise(F.lit("ok"))
