"""A whole scan: targets to bodies to references to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.config import Settings
from claimlens.operators.references import first_sources, references
from claimlens.operators.registry import unclaimed
from claimlens.sources import files, targets


def all_targets(spark: SparkSession, settings: Settings) -> DataFrame:
    """Targets of all sources in order; standard input only where no other is given."""
    parts = []
    if settings.targets:
        parts.append(targets.literal(spark, settings.targets))
    if settings.target_file:
        parts.append(targets.lines(spark, settings.target_file))
    if settings.directory:
        parts.append(targets.listed_directory(spark, settings.directory))
    if not parts:
        parts.append(targets.standard_input(spark))
    return targets.together(*parts)


def all_files(spark: SparkSession, settings: Settings, fetched: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(target_ord, source_url, body): local files behind the size gate, and remote ones of a table of fetch results.

    found: the targets, where they have been read before.
    """
    found = all_targets(spark, settings) if found is None else found
    out = files.local_files(found, settings.max_file_kb, settings.no_limit)
    if fetched is not None:
        out = out.unionByName(files.fetched_files(found, fetched, settings.max_file_kb, settings.no_limit).drop("cut"))
    return out


def findings(spark: SparkSession, settings: Settings, registry: DataFrame, fetched: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(unclaimed_package, source_url) against a registry log (package, status); names that it lacks count as 404."""
    settings = settings.checked()
    rows = references(all_files(spark, settings, fetched, found), settings.mode)
    firsts = first_sources(rows, ("target_ord", "pos"), "source_url")
    return unclaimed(firsts, registry)


def host_count(found: DataFrame) -> DataFrame:
    """n_targets and the number of distinct hosts among the remote ones."""
    from claimlens.functions.urls import host

    return found.agg(F.count("*").alias("n_targets"), F.countDistinct(host(F.col("target"))).alias("n_hosts"))
