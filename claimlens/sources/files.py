"""Bodies of targets: local files behind a size gate, stored fetch results cut to the limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.urls import is_remote


def has_script_extension(name: Column) -> Column:
    return F.lower(name).endswith(".js") | F.lower(name).endswith(".ts")


def within_limit(size: Column, max_kb: int, no_limit: bool = False) -> Column:
    """Local files of exactly the limit pass."""
    return F.lit(True) if no_limit else size <= max_kb * 1024


def truncated(body: Column, max_kb: int, no_limit: bool = False) -> tuple[Column, Column]:
    """The first bytes of a remote body, and whether they reach the limit."""
    if no_limit:
        return body, F.lit(False)
    part = F.substring(body, 1, max_kb * 1024)
    return part, F.octet_length(part) == max_kb * 1024


def as_text(body: Column) -> Column:
    """The bytes as UTF-8; what is none, such as a character that the limit cut, becomes the replacement character."""
    return F.make_valid_utf8(body.cast("string"))


def stored_files(spark: SparkSession, root: str, max_kb: int = 10_240, no_limit: bool = False) -> DataFrame:
    """(source_url, body) of script files; the size gate is pushed to the listing, before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[jJ][sS],[tT][sS]}").load(root)
    kept = files.where(within_limit(F.col("length"), max_kb, no_limit))
    return kept.select(F.col("path").alias("source_url"), as_text(F.col("content")).alias("body"))


def local_files(targets: DataFrame, max_kb: int = 10_240, no_limit: bool = False) -> DataFrame:
    """(target_ord, source_url, body) of the targets that are local paths; missing and large files are left out.

    For paths that every worker sees; stored_files reads other file systems.
    """
    limit = None if no_limit else max_kb * 1024

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            rows = []
            for order, path in zip(batch["target_ord"], batch["target"], strict=True):
                try:
                    if limit is not None and os.stat(path).st_size > limit:
                        continue
                    with open(path, "rb") as f:
                        rows.append((order, path, f.read().decode("utf-8", "replace")))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["target_ord", "source_url", "body"])

    return targets.where(~is_remote(F.col("target"))).mapInPandas(read, "target_ord long, source_url string, body string")


def fetched_files(targets: DataFrame, fetched: DataFrame, max_kb: int = 10_240, no_limit: bool = False) -> DataFrame:
    """(target_ord, source_url, body, cut) of the remote targets from a table (url, status, error, body)."""
    good = fetched.where(F.col("error").isNull() & (F.col("status") < 400))
    body, cut = truncated(F.col("body").cast("binary"), max_kb, no_limit)
    rows = targets.where(is_remote(F.col("target"))).join(good, F.col("target") == F.col("url"))
    return rows.select("target_ord", F.col("target").alias("source_url"), as_text(body).alias("body"), cut.alias("cut"))
