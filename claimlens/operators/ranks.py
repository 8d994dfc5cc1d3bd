"""Bounded ranks in two levels, and dense numbers without a window over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import stage

SALTS = 32


def least(rows: DataFrame, by: str, k: int, *order: str | Column, salt: str) -> DataFrame:
    """The k least rows of each group with `n`, their rank from 1.

    First of each group's SALTS parts, dealt by a column, then of what those leave:
    a group of any size is ranked by many tasks, and the last one sees k rows a part.
    """
    parts = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    few = parts.withColumn("n", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))).where(F.col("n") <= k)
    return few.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= k).drop("__salt")


def numbered(rows: DataFrame, number: str, *order: str | Column) -> DataFrame:
    """rows with a dense number from 0 in this order: sorted ranges, shifted by the sizes of those before."""
    placed = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    shifts, before = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row for each partition
        shifts.append((r["part"], before))
        before += r["count"]
    shift = rows.sparkSession.createDataFrame(shifts, "__part long, __before long")
    dense = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(shift), "__part").select(*rows.columns, dense.alias(number))
