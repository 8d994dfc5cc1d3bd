"""Deterministic inputs made from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bodies of script files, one for each page; braces are doubled for formatting.
FILES = """
SELECT page_id, url,
  CASE CAST(page_id % 6 AS INT)
    WHEN 0 THEN concat('import {{a}} from "', pk, '"; var x = require(', chr(39), '@', ty, '/', dk, chr(39), '); // require(', chr(39), './rel', chr(39), ')')
    WHEN 1 THEN concat('import a from ', chr(39), wk, chr(39), chr(10), 'import b from ', chr(39), pk, chr(39))
    WHEN 2 THEN concat('import a from ', chr(39), pk, chr(39), chr(10), 'import b from ', chr(39), wk, chr(39))
    WHEN 3 THEN concat('const z = require(', chr(39), pk, '/sub', chr(39), '), y = require(', chr(39), 'x', chr(39), '), w = require("', wk, '")')
    WHEN 4 THEN concat('import _ from ', chr(39), wk, chr(39), '; f(require(', chr(96), '@', ty, '/', pk, chr(96), '))')
    ELSE concat('// require(', chr(39), dk, chr(39), ')', chr(10), 'import(', chr(39), wk, chr(39), '); let q = require("@', ty, '/', wk, '/deep")')
  END AS body
FROM (SELECT p.page_id, p.url, replace(t.p_name, ' ', '-') AS pk, replace(t.p_name, ' ', '.') AS dk,
             replace(t.p_name, ' ', '') AS wk, lower(replace(t.p_type, ' ', '-')) AS ty
      FROM {pages} p JOIN {part} t ON t.p_partkey = p.page_id) f
"""

#: Answers of the registry; names that it lacks count as 404, and some lookups have failed, with or without an error.
REGISTRY = """
SELECT DISTINCT package,
  CASE WHEN length(package) % 14 = 1 THEN 'timeout' END AS error,
  CASE WHEN length(package) % 7 = 1 THEN NULL WHEN length(package) % 3 = 0 THEN 404 WHEN package LIKE 'old%' THEN 429 ELSE 200 END AS status
FROM (SELECT replace(p_name, ' ', '-') AS package FROM {part}
      UNION ALL SELECT replace(p_name, ' ', '') FROM {part}) n
"""

#: A fetch log made of events.
LOG = """
SELECT event_id, ts, concat('h', CAST(user_id % 20 AS VARCHAR(8)), '.example') AS host, user_id AS job_id,
  CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 503 ELSE 200 END AS status,
  CASE event_type WHEN 'view' THEN 'ProcessJS' WHEN 'click' THEN 'VerifyPackage' ELSE 'FetchJS' END AS job_type
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FILES, pages=table(spark, sf_dir, "pages"), part=table(spark, sf_dir, "part"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REGISTRY, part=table(spark, sf_dir, "part"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG, events=table(spark, sf_dir, "events"))


def in_duckdb(view: str) -> str:
    """The view's text over the tables by their own names."""
    return view.format(pages="pages", part="part", events="events")
