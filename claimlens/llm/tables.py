"""Reading inputs and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import shared_dir

#: One word: a run of characters other than space and the five ASCII line and tab controls.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Staged(threading.local):
    """What a thread has staged, oldest first: path and, for a table of the catalogue, its name. Threads' queries don't see each other's."""

    def __init__(self):
        self.tables: list[tuple[str, str | None]] = []


_STAGED = _Staged()


def staged_so_far() -> int:
    return len(_STAGED.tables)


def drop_staged(spark: SparkSession, since: int, until: int) -> None:
    """Delete the tables staged by this thread between two marks of staged_so_far(); nothing may read them any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path, name in _STAGED.tables[since:until]:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(hadoop).delete(where, True)
    _STAGED.tables[since:until] = [("", None)] * (until - since)


def stage_table(df: DataFrame, label: str, partition_by: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """Write df once to the shared folder and return the table: later reads need no earlier shuffle or executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").options(**options or {})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _STAGED.tables.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def stage_buckets(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """Like stage_table, in buckets of a column: joins by it need no shuffle of this side."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).format("parquet").saveAsTable(name)
    _STAGED.tables.append((path, name))
    return spark.table(name)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of a query as soon as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(column: str, n: int):
    """crc32 of the id written as text, modulo n; null ids are in no fold but 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


#: Sets of ids up to this many rows (16 MB of longs) are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def restrict(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows of df whose column is among ids (one column, staged), or with "left_anti" those whose is not."""
    side = ids.withColumnRenamed(ids.columns[0], "__id")
    if ids.count() <= BROADCAST_IDS:
        side = F.broadcast(side)
    return df.join(side, df[column] == side["__id"], how)
