"""Where targets come from: literals, list files, standard input, directories."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.names import trimmed
from claimlens.operators.ranks import numbered
from claimlens.sources import datasource

TARGETS = "target_ord long, target string"


def literal(spark: SparkSession, targets: Iterable[str]) -> DataFrame:
    """Targets as given, untrimmed, in order."""
    return spark.createDataFrame(list(enumerate(targets)), TARGETS)


def lines(spark: SparkSession, path: str, *, trim: bool = True, blanks: bool = False) -> DataFrame:
    """Lines of a text file as (target_ord, target), duplicates kept.

    trim: without white space around; blanks: empty lines stay. Order follows
    the place in the file; the numbers rise but are not dense.
    """
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("target_ord"), F.col("value").alias("target"))
    if trim:
        text = text.withColumn("target", trimmed(F.col("target")))
    return text if blanks else text.where("target <> ''")


def standard_input(spark: SparkSession, stream: Iterable[str] | None = None, *, trim: bool = True, blanks: bool = False) -> DataFrame:
    """Lines of standard input, which is read to its end first; none from a terminal."""
    stream = sys.stdin if stream is None else stream
    if getattr(stream, "isatty", lambda: False)():
        return literal(spark, [])
    found = [x.rstrip("\n").removesuffix("\r") for x in stream]
    found = [x.strip() for x in found] if trim else found
    return literal(spark, [x for x in found if x or blanks])


def directory(spark: SparkSession, root: str) -> DataFrame:
    """All files below a local directory whose names end in .js or .ts, whatever the case, in lexical order.

    Listed by the driver, as Spark's own listing leaves out names that begin with `_` or `.`.
    """

    def fail(error: OSError) -> None:
        raise error

    found = []
    for folder, folders, names in os.walk(root, onerror=fail):
        folders.sort()
        found += [os.path.join(folder, n) for n in names if n.lower().endswith((".js", ".ts"))]
    return literal(spark, sorted(found))


def listed_directory(spark: SparkSession, root: str) -> DataFrame:
    """As `directory`, listed by tasks and numbered in lexical order by them: a local path that they share, or a URI that Arrow reads."""
    files, path = datasource.opened(root)
    if files.get_file_info(path).type != FileType.Directory:
        raise NotADirectoryError(root)
    return numbered(datasource.folder_targets(spark, root).select("target"), "target_ord", "target").select("target_ord", "target")


def stored_directory(spark: SparkSession, root: str) -> DataFrame:
    """As `directory` for any file system that Spark reads, by its distributed listing; hidden names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{[jJ][sS],[tT][sS]}").load(root)
    return files.select(F.monotonically_increasing_id().alias("target_ord"), F.col("path").alias("target"))


def together(*parts: DataFrame) -> DataFrame:
    """All targets of all parts, duplicates kept, ordered by part: each is numbered densely, so that no two parts' numbers mix."""
    out = None
    for i, part in enumerate(parts):
        dense = numbered(part.select("target_ord", "target"), "__n", "target_ord") if len(parts) > 1 else part.withColumn("__n", F.col("target_ord"))
        own = dense.select((F.col("__n") + F.lit(i << 48)).alias("target_ord"), "target")
        out = own if out is None else out.unionByName(own)
    return out.where("target <> ''")
