"""Queues by host: pending work, available and blocked hosts, assignment and redistribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.operators.ranks import numbered

QUANTUM = 5


def pending(jobs: DataFrame) -> DataFrame:
    """host and pending, the sum of +1 for a job queued and -1 for one taken (column delta)."""
    return jobs.groupBy("host").agg(F.sum("delta").cast("bigint").alias("pending"))


def available(pending_hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """Hosts with work that are not blocked."""
    return pending_hosts.where("pending > 0").join(blocked.select("host"), "host", "left_anti")


def unblocked(queue: DataFrame, blocked: DataFrame) -> DataFrame:
    """Queued jobs whose host is not blocked."""
    return queue.join(blocked.select("host"), "host", "left_anti")


def statistics(pending_hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row for reports: hosts known, available and blocked, the blocked ones' list and the pending count of each host.

    It holds a value for each host; `by_host` gives the same as rows.
    """
    free = available(pending_hosts, blocked)
    counts = pending_hosts.agg(F.count("*").alias("total_domains"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("pending") > 0, F.struct("host", "pending"))))).alias("domain_job_counts"))
    return counts.join(free.agg(F.count("*").alias("available_domains"))).join(blocked.agg(F.count("*").alias("blocked_domains"), F.sort_array(F.collect_list("host")).alias("blocked_domain_list")))


def by_host(pending_hosts: DataFrame, blocked: DataFrame) -> DataFrame:
    """What `statistics` tells, as a row for each known or blocked host: pending, blocked and available."""
    held = blocked.select("host", F.lit(True).alias("held")).distinct()
    rows = pending_hosts.join(held, "host", "full")
    work, held = F.coalesce("pending", F.lit(0).cast("bigint")), F.coalesce("held", F.lit(False))
    return rows.select("host", work.alias("pending"), held.alias("blocked"), ((work > 0) & ~held).alias("available"))


def assigned(pending_hosts: DataFrame, blocked: DataFrame, worker: int) -> DataFrame:
    """The host that a worker takes: of all in order, the first free one with work from place `worker mod n` on.

    Hosts are numbered by partial counts, so the order needs no single partition.
    """
    spread = pending_hosts.withColumn("bucket", F.conv(F.substring(F.hex("host"), 1, 4), 16, 10).cast("int"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("hosts"))
    placed = spread.join(before, "bucket").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("host")) - 1)
    free = placed.where("pending > 0").join(blocked.select("host"), "host", "left_anti")
    turn = F.pmod(F.col("place") - F.pmod(F.lit(worker), F.col("hosts")), F.col("hosts"))
    return free.select("host", "pending", turn.cast("bigint").alias("turn")).orderBy("turn").limit(1)


def random_host(pending_hosts: DataFrame, blocked: DataFrame, seed: int) -> DataFrame:
    """Some free host with work, the same for the same seed."""
    return available(pending_hosts, blocked).orderBy(F.md5(F.concat_ws(" ", F.lit(seed), "host")), "host").limit(1)


def redistributed(queue: DataFrame, blocked: DataFrame, quantum: int | None = QUANTUM) -> DataFrame:
    """The jobs of blocked hosts that move to the shared queue (host null): the first `quantum` of each, or all."""
    held = queue.join(blocked.select("host"), "host", "left_semi")
    if quantum is not None:
        w = Window.partitionBy("host").orderBy("ord")
        held = held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quantum).drop("rank")
    return held.withColumnRenamed("host", "from_host").withColumn("host", F.lit(None).cast("string"))


def needs_refresh(n_available: Column, n_known: Column) -> Column:
    """Whether fewer than a third of the known hosts are available."""
    return n_available < F.floor(n_known / 3)


def fifo(queue: DataFrame) -> DataFrame:
    """Jobs with each host's together and in order, without a global sort."""
    return queue.repartition("host").sortWithinPartitions("host", "ord")


def round_robin(requests: DataFrame, proxies: DataFrame, seq: str = "seq", dense: bool = False) -> DataFrame:
    """Requests with their proxy: the i-th (from 0) gets number i mod n. The number of proxies is a scalar.

    seq gives the order; only if it is dense by itself it may stand for i, else requests are numbered first.
    """
    n = max(1, proxies.count())
    rows = requests if dense else numbered(requests, "__i", seq)
    return rows.join(proxies, F.pmod(F.col(seq if dense else "__i"), F.lit(n)) == F.col("idx")).drop("idx", "__i")
