"""Sources, sinks, the whole scan and its command line."""

import io
import json

import pytest
from pyspark.sql import functions as F

from claimlens import __main__ as cli
from claimlens import scan
from claimlens.config import Settings
from claimlens.sources import files, network, sinks, targets

TREE = ("a.js", "B.JS", "c.ts", "d.d.ts", "e.jsx", "_app.js", ".h.js", "_pages/x.js", ".hid/y.js")


@pytest.fixture
def tree(tmp_path):
    for name in TREE:
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"require('pkg-{name.replace('/', '-').replace('.', '').lower()}'); require('shared')")
    return tmp_path / "src"


def names(df):
    return [r.target for r in df.orderBy("target_ord").collect()]


def test_directories(spark, tree):
    assert sorted(x.removeprefix(f"{tree}/") for x in names(targets.directory(spark, str(tree)))) == sorted(n for n in TREE if n != "e.jsx")
    with pytest.raises(OSError):
        targets.directory(spark, str(tree / "missing"))
    assert {x.rsplit("/", 1)[1] for x in names(targets.stored_directory(spark, str(tree)))} == {"a.js", "B.JS", "c.ts", "d.d.ts"}


def test_lines(spark, tmp_path):
    (tmp_path / "list").write_text("  a \n\nb\nb\n \n")
    path = str(tmp_path / "list")
    assert names(targets.lines(spark, path)) == ["a", "b", "b"]
    assert names(targets.lines(spark, path, trim=False)) == ["  a ", "b", "b", " "]
    assert names(targets.lines(spark, path, trim=False, blanks=True)) == ["  a ", "", "b", "b", " "]
    assert names(targets.standard_input(spark, io.StringIO(" a \n\nb\r\n"))) == ["a", "b"]
    assert names(targets.together(targets.literal(spark, ["u", ""]), targets.lines(spark, path))) == ["u", "a", "b", "b"]


def test_sizes(spark, tmp_path):
    for n in (1023, 1024, 1025):
        (tmp_path / f"{n}.js").write_text("x" * n)
    found = targets.directory(spark, str(tmp_path))
    assert {len(r.body) for r in files.local_files(found, 1).collect()} == {1023, 1024}
    assert files.local_files(found, 1, True).count() == 3
    assert "LessThanOrEqual(length,1024)" in files.stored_files(spark, str(tmp_path), 1)._jdf.queryExecution().toString()
    remote = targets.literal(spark, ["http://a/1", "http://a/2", "http://a/3", "http://a/4"])
    log = spark.createDataFrame([("http://a/1", 200, None, "x" * 1023), ("http://a/2", 200, None, "x" * 1025), ("http://a/3", 404, None, "x"), ("http://a/4", None, "reset", None)], "url string, status int, error string, body string")
    assert {(len(r.body), r.cut) for r in files.fetched_files(remote, log, 1).collect()} == {(1023, False), (1024, True)}


def test_proxies(spark):
    probes = spark.createDataFrame([("a", 204, None), ("b", 200, None), ("c", 204, "late")], "url string, status int, error string")
    assert [r.url for r in network.live_proxies(probes).collect()] == ["a"]
    with pytest.raises(ValueError):
        network.live_proxies(probes.where("url = 'b'"))
    with pytest.raises(ValueError):
        network.proxy_strings(spark, "h:1", "file")


def found(spark, rows):
    return spark.createDataFrame(rows, "unclaimed_package string, source_url string")


def test_reports(spark, tmp_path):
    rows = found(spark, [("b<", "s&1"), ("a", "s2")])
    path = tmp_path / "new" / "report"
    assert sinks.write_report(rows, str(path), "json") == 2
    assert json.loads(path.read_text()) == [{"unclaimed_package": "a", "source_url": "s2"}, {"unclaimed_package": "b<", "source_url": "s&1"}]
    assert "\\u003c" in path.read_text() and "\n  {\n    \"unclaimed_package\"" in path.read_text()
    sinks.write_report(rows, str(path), "text", verbose=True)
    assert path.read_text() == "Found 2 unclaimed dependencies:\n  [+] Package: a\n      Source:  s2\n  [+] Package: b<\n      Source:  s&1\n"
    sinks.write_report(rows.limit(0), str(path), "json")
    assert path.read_text() == "[]\n"
    sinks.write_report(rows.limit(0), str(path), "json", silent=True)
    assert path.read_text() == ""
    assert sinks.write_report(rows, str(tmp_path), "text") == 2
    assert sinks.report_lines(rows.limit(0)).count() == 0
    sinks.write_table(rows, str(tmp_path / "table"))
    assert spark.read.json(str(tmp_path / "table")).count() == 2


def test_scan(spark, tree, tmp_path, capsys):
    registry = spark.createDataFrame([("shared", 200), ("pkg-ajs", 404), ("pkg-bjs", 429)], "package string, status int")
    got = scan.findings(spark, Settings(directory=str(tree)), registry)
    assert {r.unclaimed_package for r in got.collect()} == {"pkg-ajs", "pkg-cts", "pkg-ddts", "pkg-_appjs", "pkg-hjs", "pkg-_pages-xjs", "pkg-hid-yjs"}
    registry.write.parquet(str(tmp_path / "registry"))
    report = tmp_path / "out.json"
    assert cli.main(["-d", str(tree), "-o", str(report), "-json", "--registry", str(tmp_path / "registry")]) == 0
    assert len(json.loads(report.read_text())) == 7
    assert "Found 7" in capsys.readouterr().err
    assert cli.main(["-u", "x", "-proxy", "a:1", "-p", "f", "--registry", "r"]) == 1
    with pytest.raises(ValueError):
        Settings(mode="x").checked()


def test_first_source_wins(spark, tmp_path):
    for n in ("b.js", "a.js"):
        (tmp_path / n).write_text("require('same')")
    none = spark.createDataFrame([], "package string, status int")
    got = scan.findings(spark, Settings(targets=(str(tmp_path / "b.js"), str(tmp_path / "a.js"), "")), none).collect()
    assert [(r.unclaimed_package, r.source_url.rsplit("/", 1)[1]) for r in got] == [("same", "b.js")]
    assert scan.host_count(targets.literal(spark, ["http://a/1", "http://a/2", "x.js"])).first()[:] == (3, 1)
    assert got and F.col("x") is not None


def test_bodies_that_are_not_utf8_are_read(spark):
    body = "require('left-pad') é".encode()
    rows = [("http://x/cut.js", 200, None, body), ("http://x/latin.js", 200, None, b"require('caf\xe9')")]
    fetched = spark.createDataFrame(rows, "url string, status int, error string, body binary")
    targets = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "target_ord long, target string")
    part = fetched.withColumn("body", F.substring("body", 1, len(body) - 1))
    got = {r.source_url: r.body for r in files.fetched_files(targets, part).collect()}
    assert got == {"http://x/cut.js": "require('left-pad') \ufffd", "http://x/latin.js": "require('caf\ufffd')"}


def test_a_scan_tells_of_itself(spark, tree, tmp_path, caplog):
    import logging

    spark.createDataFrame([("shared", 200)], "package string, status int").write.parquet(str(tmp_path / "registry"))
    with caplog.at_level(logging.INFO, "claimlens"):
        assert cli.main(["-d", str(tree), "-H", "A: b", "-deep-scan", "--registry", str(tmp_path / "registry")]) == 0
    said = [r.getMessage() for r in caplog.records if r.name == "claimlens"]
    assert said[:3] == ["Loaded 8 targets to scan.", "Settings: Rate Limit: Auto (Max 30/s), File Size Limit: 10240 KB, Deep Scan: Enabled, Custom Headers: 1", "Starting scan with 25 workers."]
    assert said[-1].startswith("Scan finished in ")
    with caplog.at_level(logging.INFO, "claimlens"):
        assert cli.main(["-u", "https://a.example/x.js", "-o", str(tmp_path), "--registry", str(tmp_path / "registry")]) == 0
    said = [r.getMessage() for r in caplog.records if r.name == "claimlens"]
    assert "Scanning across 1 unique domains." in said and any(x.startswith("output file") for x in said)
    assert cli.main(["-d", str(tree / "missing"), "--registry", str(tmp_path / "registry")]) == 1


def test_durations():
    from claimlens.functions.measures import duration

    assert [duration(x) for x in (0.2, 7.5, 60, 3605.4)] == ["0s", "8s", "1m0s", "1h0m5s"]


def test_parts_keep_their_order(spark, tree):
    far = spark.createDataFrame([(40_000 << 33, "z"), (1, "y")], targets.TARGETS)
    both = targets.together(far, targets.literal(spark, ["a", "b"]), targets.listed_directory(spark, str(tree)))
    assert names(both)[:4] == ["y", "z", "a", "b"] and names(both)[4:] == names(targets.directory(spark, str(tree)))
    assert both.select("target_ord").distinct().count() == both.count()
