"""Throughput, progress and log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from claimlens.functions.measures import eta, percent

ALWAYS = ("INFO", "SUCCESS", "WARN_PUBLIC", "FATAL")
TICK_S = 2
#: Types of jobs that send a request.
COUNTED = ("FetchJS", "VerifyPackage")


def shown(level: Column, verbose: bool = False) -> Column:
    """Whether a log row of this level is written."""
    return F.lit(True) if verbose else level.isin(*ALWAYS)


def ticks(events: DataFrame, us: str = "us", tick_s: int = TICK_S) -> DataFrame:
    """tick (its start in seconds), n and rps for every tick from the first to the last event, idle ones too.

    The spine between the two ends is dealt over partitions by spark.range.
    """
    seen = events.groupBy((F.floor(F.col(us) / (tick_s * 1_000_000)) * tick_s).alias("tick")).agg(F.count("*").alias("n"))
    return with_idle(seen, tick_s)


def with_idle(seen: DataFrame, tick_s: int = TICK_S) -> DataFrame:
    """tick, n and rps of the ticks seen (tick, n) and of the idle ones between them."""
    low, high = seen.agg(F.min("tick"), F.max("tick")).first()
    spine = seen.sparkSession.range(low or 0, (high or 0) + tick_s if low is not None else 0, tick_s).withColumnRenamed("id", "tick")
    return spine.join(seen, "tick", "left").select("tick", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) / float(tick_s)).alias("rps"))


def requests(log: DataFrame, kinds: Sequence[str] = COUNTED) -> DataFrame:
    """One row with n, the requests that jobs of these types have made."""
    return log.where(F.col("job_type").isin(*kinds)).agg(F.count("*").alias("n"))


def counting(log: DataFrame, name: str | Observation, kinds: Sequence[str] = COUNTED) -> DataFrame:
    """The log as it is, with the number of requests observed as metric `n` of this name by whatever action reads it."""
    return log.observe(name, F.count(F.when(F.col("job_type").isin(*kinds), 1)).alias("n"))


def progress(done: DataFrame, total: int, start_us: int, order: tuple[str, str] = ("us", "event_id"), block_s: int = 3600, cells: int = 3600) -> DataFrame:
    """For each finished fetch in order: how many are done, the percentage and the time left.

    Rows are ranked within cells, of which a block of block_s seconds has `cells`,
    and shifted by the counts of the cells and blocks before, so that no window
    spans the log, or the rows of a busy hour.
    """
    block = F.floor(F.col(order[0]) / (block_s * 1_000_000))
    rows = done.withColumns({"block": block, "cell": F.floor(F.col(order[0]) * cells / (block_s * 1_000_000))})
    sizes = rows.groupBy("block", "cell").agg(F.count("*").alias("size"))
    blocks = sizes.groupBy("block").agg(F.sum("size").alias("all"))
    blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("block").orderBy("cell")) - F.col("size")
    before = sizes.select("block", "cell", inside.alias("inside")).join(blocks, "block").select("cell", (F.col("inside") + F.col("earlier")).alias("before"))
    w = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    current = F.least(F.col("before") + F.count("*").over(w), F.lit(total)).cast("bigint")
    rows = rows.join(before, "cell").withColumn("current", current)
    elapsed = (F.col(order[0]) - start_us) / 1_000_000.0
    return rows.select(order[1], "current", percent(F.col("current"), F.lit(total)).alias("percent"), eta(F.col("current"), F.lit(total), elapsed).alias("eta"))
