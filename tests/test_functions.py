"""Truth tables of the column expressions."""

import pytest
from pyspark.sql import functions as F

from claimlens.functions import measures, names, urls
from claimlens.sources import network

FOUND = [
    ("require('react'), require(`tpl`), require ('sp')", ["react", "tpl", "sp"]),
    ('require( "@a/b" )', ["@a/b"]),
    ("require('mix\")", ["mix"]),
    ("myrequire('abc') // require('cmt')", ["abc", "cmt"]),
    ("require('a'+b)", ["a"]),
    ("require('react-dom/client') require('@angular/core/testing')", []),
    ("require('./x') require('React') require('node:fs')", []),
    ("require('fs')", ["fs"]),
    ("require.resolve('rr') import('dyn') import 'side'; export {a} from 'exp'", []),
    ("import {a} from \"m2\"; import * as N from '@s/p'; import type {T} from 'tt'", ["m2", "@s/p", "tt"]),
    ('import{a}from"min"', []),
    ("import _ from 'lodash'; import $ from 'jquery'; import a_b from 'dd'", []),
    ("import a from 'aa'; import b from 'bb';", ["aa", "bb"]),
    ("import a from 'aa'\nimport b from 'bb'", ["bb"]),
    ("import a from 'a-a'\nimport b from 'bb'", ["a-a", "bb"]),
    ("import 'side'\nimport z from 'zz'", ["zz"]),
    ("require\x0b('vt')", []),
]


def values(spark, column, rows, ddl="x string"):
    return [r[0] for r in spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(rows)], f"i int, {ddl}").orderBy("i").select(column).collect()]


def test_regex_references(spark):
    assert values(spark, names.regex_references(F.col("x")), [a for a, _ in FOUND]) == [b for _, b in FOUND]


def test_long_runs_of_blanks_stay_cheap(spark):
    assert values(spark, F.size(names.regex_references(F.col("x"))), ["import" + " " * 40_000]) == [0]


@pytest.mark.parametrize(
    ("literal", "package", "keep"),
    [("@a/b", "@a/b", True), ("@a/b/c", "@a/b", True), ("@s", "@s", True), ("@s/", "@s/", True), ("r-d/c", "r-d", True), ("./x", ".", False), ("/abs", "", False), ("x", "x", False), ("https://h/x", "https:", True), ("..", "..", False), (" é\t", "é", True), ("\\x", "\\x", False)],
)
def test_normalisation(spark, literal, package, keep):
    assert values(spark, F.struct(names.normalized(F.col("x")), names.worth_checking(names.normalized(F.col("x")))), [literal]) == [(package, keep)]


def test_hosts(spark):
    got = {"http://a_b.com:8080/x": "a_b.com", "https://[::1]:8/x": "::1", "https://user:p@h.org:1/q": "h.org", "http://e.com?q=a@b": "e.com", "ex.com/x": None, "HTTP://EX.com/y": None}
    assert values(spark, urls.host(F.col("x")), list(got)) == list(got.values())
    assert values(spark, urls.host_with_default_scheme(F.col("x")), ["ex.com/x", "httpbin.example"]) == ["ex.com", None]
    assert values(spark, urls.base_url(F.col("x")), ["https://u@h.org:1/q?x", "h.org"]) == ["https://h.org:1", ""]


def test_registry_addresses(spark):
    assert [x.removeprefix(urls.REGISTRY) for x in values(spark, urls.registry_url(F.col("x")), ["@s/p", "a b", "c+d", "e=f:g"])] == ["@s%2Fp", "a%20b", "c+d", "e=f:g"]


def test_proxies(spark):
    assert values(spark, urls.proxy_url(F.col("x")), ["h:1", "h:1:u:w", "socks5://h:1", "h", "a:b:c"]) == ["http://h:1", "http://u:w@h:1", "socks5://h:1", None, None]


def test_headers(spark):
    texts = F.array(*map(F.lit, ("X-A: 1", "X-A:2", "NoColon", "U: http://x")))
    assert spark.range(1).select(network.header_map(texts, "ua", F.create_map(F.lit("U"), F.lit("own")))).first()[0] == {"User-Agent": "ua", "X-A": "2", "U": "own"}
    assert spark.range(1).select(network.header_map(F.array().cast("array<string>"))).first()[0] == {}


def test_headers_are_parsed_once(spark):
    texts = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit(" N"), (i % 200).cast("string"), F.lit(": a:\n"), i.cast("string"), F.lit(" ")))
    made = spark.range(1).select(network.header_map(texts, "ua", F.create_map(F.lit("N7"), F.lit("own"))).alias("m"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") <= 6 and "regexp" not in plan
    want = {"User-Agent": "ua"} | {f"N{i % 200}": f"a:\n{i}" for i in range(1, 401)} | {"N7": "own"}
    assert made.first()[0] == want
    odd = F.array(*map(F.lit, (":v", "k:", "é:ü:x", " \n: y", None, "")))
    assert spark.range(1).select(network.header_map(odd)).first()[0] == {"": "v", "k": "", "é": "ü:x", "\n": "y"}
    assert spark.range(1).select(network.header_map(F.lit(None).cast("array<string>"), "ua")).first()[0] is None


def test_backoff_and_rates(spark):
    assert values(spark, measures.backoff_seconds(F.col("x")), list(range(1, 9)), "x int") == [4, 8, 16, 32, 60, 60, 60, 60]
    assert values(spark, measures.backoff_seconds(F.col("x")), [500], "x int") == [60]
    assert values(spark, measures.cut(F.col("x")), [2.0, 0.1], "x double") == [2.0 * 0.7, 0.1]
    assert values(spark, measures.raised(F.col("x"), 2.1), [1.0, 2.0], "x double") == [1.2, 2.1]


def test_progress(spark):
    rows = [(0, 2, 5.0), (1, 2, 0.5), (2, 2, 3.0), (1, 11, 9.0), (1, 2, 59.0), (1, 2, 3600.0)]
    assert values(spark, measures.eta(F.col("c"), F.col("t"), F.col("e")), rows, "c bigint, t bigint, e double") == ["calculating...", "calculating...", "done", "1m30s", "59s", "1h0m"]
    assert values(spark, measures.percent(F.col("c"), F.col("t")), [(0, 0), (1, 4)], "c bigint, t bigint") == [100.0, 25.0]
    assert values(spark, measures.progress_bar(F.col("x")), [25.0], "x double") == ["█" * 10 + " " * 30]


def test_small_text(spark):
    assert values(spark, measures.job_type(F.col("x")), [0, 1, 2], "x int") == list(measures.JOB_TYPES)
    assert values(spark, measures.bytes_to_kb(measures.kb_to_bytes(F.col("x"))), [3], "x bigint") == [3]
    assert values(spark, measures.elapsed_seconds(F.lit(0), F.col("x")), [1_499_999, 1_500_000], "x bigint") == [1, 2]


def test_micros_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.123456' AS ts").select(measures.micros(F.col("ts"))).first()[0] == 1_710_037_800_123_456
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
