"""Quality rules, url rules, fingerprints and mixing: native operators."""

import collections
import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from claimlens.llm import fingerprints, mixing, quality_rules, url_rules
from claimlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import EDGE, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(spark, sf=SF):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def counted(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(grams)
    covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, edge, empty):
    rows = quality_rules.with_statistics(edge.withColumn("key", F.coalesce("text", F.lit("none")))).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert tuple(r["__stats"][c] for c in quality_rules.BASE) == counted(r.text)
    assert quality_rules.with_statistics(empty).count() == 0


def test_rules_find_what_is_bad(spark):
    rows = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    known = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(known)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(known[r.doc_id]) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert sum(q == int(k) for q, k in judged) >= 0.98 * len(judged)


def test_rules_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_rules.reject(edge, none)
    assert kept.columns == edge.columns
    assert {r.doc_id for r in kept.collect()} == {7, 8, 11}
    assert quality_rules.reject(empty, none).count() == 0
    odd = spark.createDataFrame([(7, 1), (7, 0), (8, None), (99, 0)], "doc_id long, quality int")
    assert quality_rules.reject(edge, odd).count() == 4


def test_a_rule_is_learned(spark):
    rows = [(i, f"{'bad!! ' if i % 4 == 0 else 'good '}" * 30 + " ".join(f"w{i}q{j}" for j in range(60)), None, None) for i in range(400)]
    stats = quality_rules.with_statistics(table(spark, rows), keep=["doc_id"]).withColumn("__stats", F.col("__stats").withField("n_repeat_words", F.lit(0).cast("long")))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)], "doc_id long, quality int")
    rules = quality_rules.fit(stats, labels)
    assert len(rules) == 1 and [c.feature for c in rules[0]] == ["bangs_per_word"] and str(rules[0][0]).startswith("bangs_per_word >")
    assert {r.doc_id for r in quality_rules.judge(stats, rules, ["doc_id"]).where("not kept").collect()} == set(range(0, 400, 4))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    from tests.test_entry import matches

    matches(spark, name, QUERIES[name], ORACLE_SQL[name])


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/en/12#x", "http://example.org", "http://notexample.org/es/", "http://a.com/fr/?q", "http://a.com?/fr/", "x://a.com/de/b", "http://u@b.org:80/es/", "http://a.net/x/login", "http://casino.x.com/fr/"]
    rows = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, other string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(rows).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("example.org", "", None, "allow")
    assert got[6] == ("notexample.org", "/es/", "org/", "allow")
    assert got[7][2:] == ("com/fr/", "allow") and got[8] == ("a.com", "", None, "allow")
    assert got[9][2:] == ("com/de/", "block")
    assert got[10] == ("u@b.org:80", "/es/", None, "allow")
    assert got[11][2:] == (None, "block") and got[12][2:] == ("com/fr/", "allow")
    assert url_rules.judge(rows.limit(0)).count() == 0
    assert {r.verdict for r in url_rules.judge(rows, []).collect()} == {"allow"}
    assert {r.verdict for r in url_rules.judge(rows, [url_rules.pattern_rule("block", ".*", ())]).collect()} == {"block"}


def test_long_lists_and_rules_without_tokens(spark):
    rules = [url_rules.host_rule("block", f"site{i}.net/a/") for i in range(20_000)] + [url_rules.host_rule("block", "例え/")]
    rows = spark.createDataFrame([("http://site19999.net/a/b",), ("http://例え/x",), ("http://other.net/",)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_rules.judge(rows, rules).collect()}
    assert got == {"http://site19999.net/a/b": ("site19999.net/a/", "block"), "http://例え/x": ("例え/", "block"), "http://other.net/": (None, "allow")}


def test_only_indexed_rules_run(spark):
    rules = [url_rules.host_rule("block", f"site{i}.net/a/") for i in range(300)]
    rows = spark.createDataFrame([("http://site7.net/a/b",), ("http://other.net/a/b",)], "url string")
    got = url_rules.judge(rows, rules).collect()
    assert [(r.rule, r.n_run) for r in got] == [("site7.net/a/", 1), (None, 0)]


def folded(text):
    return unicodedata.normalize("NFKC", text).casefold()


def test_canonical(spark):
    rows = ["Ａé", "Ae\u0301", "A\u00e9 \u00a0\t\u2003B\u2028c", "ﬁ", "x\x85y", "\u1e69", "s\u0323\u0307", "s\u0307\u0323", "Straße", "STRASSE", "\U0001d400", "\u1112\u1161\u11ab", "\ud55c", "ΣΑΣ"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(fingerprints.canonical(F.col("t"))).collect()]
    assert got == ["aé", "aé", "aé b c", "fi", "x y", "ṩ", "ṩ", "ṩ", "strasse", "strasse", "a", "한", "한", "σασ"]


def test_canonical_is_normalised_and_folded_for_all_characters(spark):
    rng = random.Random(4)
    assigned = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cn", "Cs") and not chr(i).isspace()]
    marks = [c for c in assigned if unicodedata.combining(c)]
    jamo = [chr(i) for i in range(0x1100, 0x1200)]
    mixed = ["".join(rng.choice(kind) for kind in rng.choices([assigned, marks, jamo], [1, 3, 1], k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [t for t in assigned + mixed if not any(c.isspace() or c in "\x1c\x1d\x1e\x1f" for c in t + folded(t))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    assert not [r.t for r in df.select("t", fingerprints.canonical(F.col("t")).alias("c")).collect() if r.c != folded(r.t)]


def expected_edits(rows):
    out = []
    for i, (_, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()))
    return out


def test_fingerprints(spark, edge, empty):
    known = sorted(texts(spark).items())
    got = QUERIES["op6_fingerprints"](spark, SF).orderBy("doc_id").collect()
    assert [(r.n_chars, r.edited_sha256) for r in got] == expected_edits(known)
    by_text = collections.defaultdict(set)
    for r, (_, t) in zip(got, known, strict=True):
        by_text[t].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(table(spark, [(5, "abcd", None, None)])).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_fingerprints_of_odd_rows(spark, edge):
    rows = sorted((i, t) for i, t, _, _ in EDGE if i is not None and i != 11) + [(11, EDGE[10][1])] * 2
    known = sorted(rows, key=lambda r: r[0])
    got = fingerprints.edited_fingerprints(table(spark, [(i, t, None, None) for i, t in known])).orderBy("doc_id").collect()
    assert [(r.n_chars, r.edited_sha256) for r in got] == expected_edits(known)
    assert fingerprints.edited_fingerprints(edge).count() == len(EDGE)
    assert got[3].near_next == 1.0


@pytest.mark.parametrize("spread", [lambda i: i * i * 37, lambda i: i, lambda i: 10**12 if i == 59 else -i, lambda i: 2 ** (i % 60)])
def test_following_over_many_ranges(spark, monkeypatch, spread):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    rows = [(spread(i), str(i), None, None) for i in range(60)]
    got = fingerprints.with_next(table(spark, rows).select("doc_id", "text")).collect()
    order = [t for _, t, _, _ in sorted(rows)]
    assert {(r.text, r.next_text) for r in got} == set(zip(order, order[1:] + order[:1], strict=True))


def test_ranges_are_bounded_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 50)
    sparse = [(i, f"a{i}", None, None) for i in range(2000)] + [(10**12, "far", None, None)]
    crowded = [(7, f"b{i}", None, None) for i in range(1000)] + [(None, f"c{i}", None, None) for i in range(1000)]
    for rows in (sparse, sparse + crowded):
        parts = fingerprints._parted(table(spark, rows).select("doc_id", "text"))
        assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 4 * 50
        ordered = parts.orderBy("part").select("part", "doc_id", "h").collect()
        spans = collections.defaultdict(list)
        for r in ordered:
            spans[r.part].append((r.doc_id is not None, r.doc_id or 0, r.h))
        ends = [(min(v), max(v)) for v in spans.values()]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_groups_compare_bytes(spark):
    docs = table(spark, [(i, f"text {i % 3}", None, None) for i in range(30)])
    same = lambda c: F.substring(fingerprints.digest(c), 1, 0)  # noqa: E731  all digests are equal
    digests = docs.select(same(F.col("text")).alias("digest"), "doc_id")
    got = fingerprints.exact_groups(docs, digests, make_digest=same).collect()
    assert {(r.doc_id, r.same_id) for r in got} == {(i, i % 3) for i in range(30)}


def test_mix_edges(spark, edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE)
    assert all(r.taken <= 3 * r.size and r.taken == r.times * r.size for r in got)
    assert sorted((r.doc_id, r.taken) for r in got if r.doc_id) == sorted((r.doc_id, r.taken) for r in mixing.mix(edge).collect() if r.doc_id)
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    out = mixing.apply_mix(edge)
    assert out.columns == edge.columns
    assert out.where("doc_id = 7").count() == next(r.times for r in got if r.doc_id == 7)
    nothing = table(spark, [(1, None, None, "a"), (2, "", None, "b")])
    assert [r.taken for r in mixing.mix(nothing).collect()] == [0, 0]


def test_mix_meets_targets(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).groupBy("source_key").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("all"), F.first("source_size").alias("own")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target and r["all"] == r.own for r in rows)
    assert abs(sum(r.target for r in rows) - sum(r.own for r in rows)) < 1
