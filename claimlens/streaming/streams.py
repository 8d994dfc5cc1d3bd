"""Structured Streaming forms: packages seen for the first time, host states, throughput, and their replay in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimlens.functions.measures import micros
from claimlens.operators.ratecontrol import HostReplay
from claimlens.operators.references import references

_STATE = "rate double, retries int, until long, sent long, delayed long, refused long, tokens double, last long"
_OUT = "host string, rate double, retry_counter int, next_attempt_us long, discarded boolean, sent long, delayed long, rejected long, event string"
#: Keyed state with timers needs this store.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of a file, and files of a batch, of a log that is streamed in order.
FILE_ROWS = 200_000
MAX_FILES = 8


def file_stream(spark: SparkSession, path: str, schema: Any, kind: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New files of a folder as a stream; max_files bounds what one batch takes, as a full queue would."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).format(kind).load(path)


def in_order(rows: DataFrame, path: str, *order: str) -> list[DataFrame]:
    """The rows in parts of MAX_FILES * FILE_ROWS or so, each after the other in ascending order, staged below path."""
    n = max(1, -(-rows.count() // FILE_ROWS))
    part = F.spark_partition_id().alias("__part")
    rows.repartitionByRange(n, *order).select("*", part).write.partitionBy("__part").parquet(path)
    staged = rows.sparkSession.read.schema(rows.schema).parquet
    folders = _folders(rows.sparkSession, path)
    return [staged(*folders[i : i + MAX_FILES]) for i in range(0, len(folders), MAX_FILES)] or [rows.limit(0)]


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [str(f.getPath().toString()) for f in found if "__part=" in f.getPath().getName()]
    return sorted(names, key=lambda x: int(x.rpartition("=")[2]))


def beat(rows: DataFrame, moment: Column, time: str = "ts", **values: Any) -> DataFrame:
    """One row of the same columns with a moment and nothing else: it moves a stream's watermark on when its source falls silent.

    Where a join or filter asks for a column, Spark drops nulls below the watermark:
    values give it one that nothing meets.
    """
    spark = rows.sparkSession
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return spark.range(1).select(*[(moment if c == time else F.lit(values.get(c))).cast(kinds[c]).alias(c) for c in rows.columns])


def replay(parts: list[DataFrame], path: str, make: Callable[[DataFrame], DataFrame], mode: str, last: DataFrame | None = None, keyed: bool = True) -> DataFrame:
    """What a stream puts out over the parts, one after the other: a part is written, and the stream run over it, before the next one.

    The order rests on what each run finds new, not on the times of files, which
    object stores do not keep. An interrupted run goes on from its checkpoint. A
    beat may come last.
    """
    spark, out = parts[0].sparkSession, None
    for part, folder in [*[(x, "in") for x in parts], *[(x, "beat") for x in (last,) if x is not None]]:
        part.write.mode("append").parquet(f"{path}/{folder}")
        stream = make(file_stream(spark, f"{path}/{{in,beat}}", parts[0].schema))
        out = drain(stream, f"{path}/out", f"{path}/state", mode, keyed)
    return out


def new_packages(files: DataFrame, mode: str = "regex") -> DataFrame:
    """Each package once over the whole stream, with a source that refers to it."""
    return references(files, mode).select("package", F.col("url").alias("source_url")).dropDuplicates(["package"])


def new_packages_within(files: DataFrame, time: str, delay: str, mode: str = "regex") -> DataFrame:
    """As new_packages, with state kept only for the delay."""
    return references(files, mode).withWatermark(time, delay).dropDuplicatesWithinWatermark(["package"])


class _Host(StatefulProcessor):
    """A host's rate control as value state; a timer stands where its backoff ends, and one where it has been idle for long."""

    def __init__(self, max_rate: float, idle_s: int | None):
        self.max_rate, self.idle_s = max_rate, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("host", _STATE)

    def _row(self, key: tuple, host: HostReplay, event: str) -> pd.DataFrame:
        rate, retries, until, sent, delayed, refused, _, _ = host.state()
        return pd.DataFrame([(key[0], rate, retries, until, host.discarded, sent, delayed, refused, event)], columns=["host", "rate", "retry_counter", "next_attempt_us", "discarded", "sent", "delayed", "rejected", "event"])

    def _host(self) -> HostReplay:
        old = self.state.get() if self.state.exists() else None
        return HostReplay(self.max_rate, old and (*old[:7], None if old[7] < 0 else old[7]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        host = self._host()
        part = pd.concat(list(rows)).sort_values(["us", "event_id"])
        for us, status, error in zip(part["us"].tolist(), part["status"].tolist(), part["error"].tolist(), strict=True):
            host.request(us, None if status is None or status != status else int(status), error if isinstance(error, str) else None)
        last = int(part["us"].iloc[-1])
        self.state.update((*host.state()[:7], -1 if host.last is None else host.last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if host.until > last and not host.discarded:
            self.handle.registerTimer(host.until // 1000 + 1)
        if self.idle_s is not None:
            self.handle.registerTimer(max(last, host.until) // 1000 + 1000 * self.idle_s)
        yield self._row(key, host, "batch")

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        host = self._host()
        moment = expiredTimerInfo.getExpiryTimeInMs()
        if moment == host.until // 1000 + 1:
            yield self._row(key, host, "free")
        else:
            self.state.clear()
            yield self._row(key, host, "idle")

    def close(self) -> None:
        pass


def host_states(log: DataFrame, max_rate: float = 30.0, *, delay: str = "1 second") -> DataFrame:
    """A row with the state of each host after every batch that brings requests of it."""
    return host_events(log, max_rate, delay=delay).where("event = 'batch'").drop("event")


def host_events(log: DataFrame, max_rate: float = 30.0, *, delay: str = "1 second", idle_s: int | None = None) -> DataFrame:
    """A row with the state of each host after every batch that brings requests of it (event `batch`), and what timers tell.

    A host's rows of one batch are replayed in order of time; a batch holds what
    one trigger takes, so the source's limit bounds it. When the watermark passes
    the end of a host's backoff, a row says so (`free`); with idle_s, a host that has
    sent nothing for so long is forgotten (`idle`), begins anew if it comes back,
    and takes no more room in the state. Requests older than the watermark are
    dropped; a row without host only moves the watermark on.
    """
    us, utc = micros(F.col("ts")), F.timestamp_micros(micros(F.col("ts"))).alias("at")
    error = (F.col("error") if "error" in log.columns else F.lit(None)).cast("string").alias("error")
    rows = log.select("host", "event_id", us.alias("us"), F.col("status").cast("int").alias("status"), error, utc).withWatermark("at", delay)
    return rows.where("host is not null").groupBy("host").transformWithStateInPandas(_Host(max_rate, idle_s), _OUT, "Update", "eventTime")


def throughput(events: DataFrame, time: str = "ts", delay: str = "10 seconds", tick: str = "2 seconds") -> DataFrame:
    """Requests per second of each tick that the watermark has closed."""
    seen = events.withWatermark(time, delay).groupBy(F.window(time, tick).alias("w")).count()
    return seen.select(F.col("w.start").alias("tick"), F.col("count").alias("n"), (F.col("count") / 2.0).alias("rps"))


class _Ticks(StatefulProcessor):
    """Puts out closed ticks, and by timers the ticks that close without events: runs (first, last, n), in milliseconds."""

    def __init__(self, tick_s: int):
        self.ms = 1000 * tick_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "start long")

    def _put_out(self, runs: list[tuple[int, int, int]]) -> pd.DataFrame:
        """The next tick after the runs is closed when the watermark reaches its end."""
        self.last.update((runs[-1][1],))
        self.handle.registerTimer(runs[-1][1] + 2 * self.ms)
        return pd.DataFrame(runs, columns=["first", "last", "n"])

    def _closed(self, timerValues: Any) -> int:
        return (timerValues.getCurrentWatermarkInMs() // self.ms - 1) * self.ms

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        runs, before = [], self.last.get()[0] if self.last.exists() else None
        seen = sorted((int(t), int(n)) for part in rows for t, n in zip(part["start"], part["n"], strict=True))
        # Idle ticks that have closed since the last event have no timer of their own yet.
        for start, n in [*seen, (self._closed(timerValues) + self.ms, None)]:
            if before is not None and before + self.ms < start:
                runs.append((before + self.ms, start - self.ms, 0))
            if n is not None:
                runs.append((start, start, n))
                before = start
        yield self._put_out(runs)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        first = expiredTimerInfo.getExpiryTimeInMs() - self.ms
        yield self._put_out([(first, max(first, self._closed(timerValues)), 0)])

    def close(self) -> None:
        pass


def ticks(events: DataFrame, time: str = "ts", delay: str = "10 seconds", tick_s: int = 2) -> DataFrame:
    """tick (its start in seconds), n and rps of every tick from the first event on, idle ones too, once the watermark has closed it.

    Events are counted by tick in the JVM; one row for each tick with events goes
    through the keyed state that knows the last one put out, and one comes out for
    each run of idle ticks, which the JVM takes apart. A row whose other
    columns are all null (see beat) counts for nothing and only moves the watermark.
    """
    real = F.coalesce(*[F.col(c).cast("string") for c in events.columns if c != time], F.lit(None).cast("string")) if len(events.columns) > 1 else F.lit("")
    seen = events.withWatermark(time, delay).groupBy(F.window(time, f"{tick_s} seconds").alias("w")).agg(F.count(real).alias("n")).where("n > 0")
    closed = seen.select(F.lit(0).alias("all"), F.unix_millis("w.start").alias("start"), "n", F.window_time("w").alias("at"))
    runs = closed.groupBy("all").transformWithStateInPandas(_Ticks(tick_s), "first long, last long, n long", "Append", "eventTime")
    each = F.explode(F.sequence(F.col("first"), F.col("last"), F.lit(1000 * tick_s)))
    return runs.select(each.alias("tick"), "n").select((F.col("tick") / 1000).cast("long").alias("tick"), "n", (F.col("n") / float(tick_s)).alias("rps"))


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keyed: bool = True) -> DataFrame:
    """Run the stream over what is there, wait for its end, and give the rows that it put out.

    keyed: it has value state or timers, so it needs a store that holds them; else the session's own store is taken.

    Each batch goes to a folder of its own, which a repeated batch overwrites.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/batch=-1")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    with _keyed_store(spark) if keyed else nullcontext():
        query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(path).select(*stream.columns)


@contextmanager
def _keyed_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state where timers and value state can be held."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over what is there into a folder of Parquet files."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
