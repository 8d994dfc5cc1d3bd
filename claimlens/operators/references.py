"""References from bodies to packages, and their first sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.names import normalized, regex_references, worth_checking
from claimlens.operators.deep import deep_references

MODES = ("regex", "deep_full", "deep_strict")


def raw_references(files: DataFrame, mode: str = "regex", body: str = "body", outer: bool = False) -> DataFrame:
    """The columns of files but the body, with pos and name of every specifier found; with outer, nulls for a file without any."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    kept = [c for c in files.columns if c != body]
    found = regex_references(F.col(body)) if mode == "regex" else deep_references(F.col(body), strict=mode == "deep_strict")
    return files.select(*kept, (F.posexplode_outer if outer else F.posexplode)(found).alias("pos", "name"))


def references(files: DataFrame, mode: str = "regex", body: str = "body", outer: bool = False) -> DataFrame:
    """As raw_references, with the normalised package of each name that is worth a lookup.

    With outer, Spark reads files without names up to this filter too, instead of dropping them below a watermark.
    """
    rows = raw_references(files, mode, body, outer).withColumn("package", normalized(F.col("name")))
    return rows.where(worth_checking(F.col("package")))


def references_per_file(files: DataFrame, body: str = "body") -> DataFrame:
    kept = [c for c in files.columns if c != body]
    return files.select(*kept, F.size(regex_references(F.col(body))).cast("bigint").alias("n_refs"))


def first_sources(refs: DataFrame, order: tuple[str, ...] = ("page_id", "pos"), source: str = "url") -> DataFrame:
    """Each package once, with the source that refers to it first; partial results keep popular packages small."""
    return refs.groupBy("package").agg(F.min_by(source, F.struct(*order)).alias("source_url"))


def first_references(refs: DataFrame, order: tuple[str, ...] = ("page_id", "pos")) -> DataFrame:
    """The whole first row of each package; partial results here too, where a ranking would sort a popular package in one task."""
    first = refs.groupBy("package").agg(F.min_by(F.struct(*refs.columns), F.struct(*order)).alias("row"))
    return first.select("row.*")
