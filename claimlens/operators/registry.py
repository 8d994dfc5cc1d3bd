"""Lookups of packages in a registry log (package, status, and error if it has that column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNCLAIMED, CLAIMED = 404, 200


def outcome(status: Column, error: Column | None = None) -> Column:
    """What a lookup says of a name. Only an explicit 404 means unclaimed; a lookup without a status has failed."""
    failed = status.isNull() if error is None else status.isNull() | error.isNotNull()
    return F.when(failed, F.lit("failed")).when(status == UNCLAIMED, F.lit("unclaimed")).when(status == CLAIMED, F.lit("claimed")).otherwise(F.lit("unknown"))


def answered_otherwise(log: DataFrame) -> DataFrame:
    """Packages (one column) with an answer other than 404, or a failed lookup."""
    return log.where(outcome(F.col("status"), _error(log)) != "unclaimed").select("package")


def unclaimed(firsts: DataFrame, log: DataFrame) -> DataFrame:
    """Findings: packages for which the log has no other answer than 404; failed lookups are never findings."""
    left = firsts.join(answered_otherwise(log), "package", "left_anti")
    return left.select(F.col("package").alias("unclaimed_package"), "source_url")


def claimed(firsts: DataFrame, log: DataFrame) -> DataFrame:
    return firsts.join(log.where(outcome(F.col("status"), _error(log)) == "claimed").select("package"), "package", "left_semi")


def outcomes(firsts: DataFrame, log: DataFrame) -> DataFrame:
    """Every package with its status (404 if the log lacks it, null if its lookup failed without one) and what that means."""
    answers = log.select("package", "status", _error(log).alias("error"), F.lit(True).alias("asked"))
    status = F.when(F.col("asked").isNull(), UNCLAIMED).otherwise(F.col("status"))
    rows = firsts.join(answers, "package", "left")
    return rows.select("package", "source_url", status.cast("bigint").alias("status"), outcome(status, F.col("error")).alias("outcome"))


def _error(log: DataFrame) -> Column:
    return F.col("error") if "error" in log.columns else F.lit(None).cast("string")
