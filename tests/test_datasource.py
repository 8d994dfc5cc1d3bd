"""Targets and reports as data sources, against the driver's walk and the streamed report."""

import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.sources import datasource, sinks, targets
from tests.test_scan import TREE, names


@pytest.fixture
def tree(tmp_path):
    inner = [f"d{i}/e{j}/f{k}.{e}" for i in range(5) for j in range(3) for k, e in enumerate(("js", "TS", "py", "mjs"))]
    for name in (*TREE, *inner, "deep/er/and/deep.er/x.Js"):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    (tmp_path / "src" / "none").mkdir()
    (tmp_path / "src" / "folder.js").mkdir()
    os.symlink(tmp_path / "src" / "d1", tmp_path / "src" / "link")
    return tmp_path / "src"


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_folders_are_those_of_the_walk(spark, tree, partitions):
    want = names(targets.directory(spark, str(tree)))
    found = datasource.folder_targets(spark, str(tree), partitions)
    assert sorted(r.target for r in found.collect()) == want and len(want) > 30
    assert found.rdd.getNumPartitions() <= partitions
    assert sorted(r.target for r in datasource.folder_targets(spark, f"file://{tree}").collect()) == want


def test_missing_and_empty_folders(spark, tmp_path):
    assert datasource.folder_targets(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        datasource.folder_targets(spark, str(tmp_path / "missing")).count()
    with pytest.raises(Exception, match="missing"):
        datasource.line_targets(spark, str(tmp_path / "missing")).count()


@pytest.mark.parametrize("partitions", [1, 2, 5, 64])
@pytest.mark.parametrize("text", ["  a \n\nb\r\nb\n \n", "", "x", "one\ntwo", "\n\n", "é \nlong line " + "y" * 100 + "\nz\n"])
def test_lines_are_those_of_the_text_source(spark, tmp_path, text, partitions):
    path = tmp_path / "list"
    path.write_text(text, newline="")
    for trim, blanks in ((True, False), (False, False), (False, True), (True, True)):
        got = [r.target for r in datasource.line_targets(spark, str(path), trim=trim, blanks=blanks, partitions=partitions).orderBy("part", "place").collect()]
        assert got == names(targets.lines(spark, str(path), trim=trim, blanks=blanks))


@given(st.text(alphabet=st.sampled_from("a \t\x0b\x1c\x85\xa0 b"), max_size=8))
def test_white_space_is_that_of_the_other_sources(text):
    assert datasource._stripped(text) == text.strip("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


ROWS = [("b<", "s&1"), ("a", 'q"2'), ("a", "é\n"), ("@x/y", "u>3")]


@pytest.mark.parametrize("kind", ["json", "text"])
@pytest.mark.parametrize(("verbose", "silent"), [(False, False), (True, True)])
def test_report_bytes(spark, tmp_path, kind, verbose, silent):
    rows = spark.createDataFrame(ROWS, "unclaimed_package string, source_url string").withColumn("more", F.lit(1))
    for n, df in (("some", rows), ("none", rows.limit(0))):
        sinks.write_report(df, str(tmp_path / n / "want"), kind, verbose, silent)
        datasource.save_report(df, str(tmp_path / n / "got"), kind, verbose, silent)
        assert (tmp_path / n / "got").read_bytes() == (tmp_path / n / "want").read_bytes()
        assert sorted(os.listdir(tmp_path / n)) == ["got", "want"]


def test_a_million_findings_give_the_same_bytes(spark, tmp_path, monkeypatch):
    rows = spark.range(1_000_000).select(F.concat(F.lit("p<"), F.pmod(F.xxhash64("id"), F.lit(700_000)).cast("string")).alias("unclaimed_package"), F.concat(F.lit("s"), F.col("id")).alias("source_url")).cache()
    sinks.write_report(rows, str(tmp_path / "want"), "json")
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    datasource.save_report(rows, str(tmp_path / "got"), "json")
    assert (tmp_path / "got").read_bytes() == (tmp_path / "want").read_bytes()
    rows.unpersist()


def test_an_aborted_report_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).select(F.when(F.col("id") == 50, F.raise_error(F.lit("no"))).otherwise(F.lit("p")).cast("string").alias("unclaimed_package"), F.lit("s").alias("source_url"))
    with pytest.raises(Exception, match="no"):
        datasource.save_report(bad, str(tmp_path / "out" / "report"))
    assert not (tmp_path / "out").exists() or not os.listdir(tmp_path / "out")
