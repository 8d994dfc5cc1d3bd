"""Findings as files and as text. Tables of any size are written by Spark; one-file forms are for reports."""

from __future__ import annotations

import json
import logging
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.functions.measures import REPORT_HEAD, REPORT_PACKAGE, REPORT_SOURCE, report_line

log = logging.getLogger("claimlens")


def report_lines(findings: DataFrame, verbose: bool = False) -> DataFrame:
    """(ord, line): a header with the count, then a line for each finding; no row without findings."""
    n = findings.agg(F.count("*").alias("n")).where("n > 0")
    head = n.select(F.lit(0).alias("ord"), F.format_string(REPORT_HEAD, F.col("n")).alias("line"))
    body = findings.select(F.lit(1).alias("ord"), report_line(F.col("unclaimed_package"), F.col("source_url"), verbose).alias("line"))
    return head.unionByName(body)


def write_table(findings: DataFrame, path: str, kind: str = "json") -> None:
    """Findings as a folder of JSON lines, Parquet or text lines, from all executors."""
    writer = findings.write.mode("overwrite")
    if kind == "text":
        findings.select(report_line(F.col("unclaimed_package"), F.col("source_url")).alias("value")).write.mode("overwrite").text(path)
    else:
        writer.format(kind).save(path)


def _escaped(text: str) -> str:
    for c in "&<>":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def write_report(findings: DataFrame, path: str, kind: str = "text", verbose: bool = False, silent: bool = False) -> int:
    """One report file, rows streamed from Spark a partition at a time; the number of findings.

    json: an array with two-space indent, `[]` if empty, with & < > escaped.
    text: nothing without findings. Silent and empty: an empty file.
    """
    rows = findings.orderBy("unclaimed_package", "source_url")
    n = findings.count()
    try:
        os.makedirs(os.path.dirname(os.path.abspath(path)), mode=0o750, exist_ok=True)
        out = open(path, "w", encoding="utf-8")  # noqa: SIM115
    except OSError as e:
        log.error("output file: %s", e)
        return n
    with out:
        if silent and not n:
            return n
        if kind == "json":
            out.write("[" if n else "[]")
            for i, r in enumerate(rows.toLocalIterator()):
                item = json.dumps({"unclaimed_package": r["unclaimed_package"], "source_url": r["source_url"]}, indent=2, ensure_ascii=False)
                out.write((",\n" if i else "\n") + "\n".join("  " + x for x in _escaped(item).split("\n")))
            out.write("\n]\n" if n else "\n")
        elif n:
            for line in _text_lines(rows, n, verbose):
                out.write(line + "\n")
    return n


def _text_lines(rows: DataFrame, n: int, verbose: bool) -> Iterator[str]:
    if n:
        yield REPORT_HEAD % n
    for r in rows.toLocalIterator():
        yield REPORT_PACKAGE % r["unclaimed_package"]
        if verbose:
            yield REPORT_SOURCE % r["source_url"]


def print_summary(findings: DataFrame, silent: bool = False, verbose: bool = False) -> None:
    """The findings for people on standard error, streamed a partition at a time; nothing if silent, one line without findings."""
    if silent:
        return
    n = findings.count()
    if not n:
        print("No unclaimed dependencies found.", file=sys.stderr)
    for line in _text_lines(findings.orderBy("unclaimed_package", "source_url"), n, verbose):
        print(line, file=sys.stderr)
