"""Lexical search, importance resampling and the n-gram join against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimlens.llm import bytewords, importance, lexical_search, near_duplicates, ngram_join
from claimlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import EDGE, table
from tests.llm.test_texts import brute_components, documents, near_copies
from tests.test_entry import rows as comparable

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def terms(text):
    return TERM.findall(lowered(text))


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_importance", "op13_ngram_join"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns, want = [d[0] for d in want.description], want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert comparable(got.columns, [tuple(r) for r in got.collect()]) == comparable(columns, want)


# Words in bytes


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aZ9_ \n-éß日😀\x00\x7f\x80"), max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(["skip", *texts, "skip"], pa.string()).slice(1, len(texts))
    found = bytewords.words(column)
    got = [[] for _ in texts]
    for i, t in enumerate(found.text):
        got[t].append(found.bytes_of(i).decode())
    assert got == [terms(t) for t in texts]
    by_word = dict(zip([w for ws in got for w in ws], bytewords.hashes(found).tolist(), strict=False))
    assert len(set(by_word.values())) == len(by_word)
    assert bytewords.hashes(found).tolist() == [by_word[w] for ws in got for w in ws]


@settings(max_examples=40, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_feature_buckets_are_crcs(texts, most):
    texts = [*texts, "x" * most + " " + "y" * (most // 2), "long" * 40 + " " + "é" * 90]
    bucket, text = importance.features(bytewords.words(pa.array(texts, pa.string())))
    want = [(i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for w in [terms(t)] for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]
    assert sorted(zip(text.tolist(), bucket.tolist(), strict=True)) == sorted(want)


def test_slices_cover_a_batch(monkeypatch):
    monkeypatch.setattr(bytewords, "SLICE_BYTES", 20)
    batch = pa.record_batch([pa.array(range(7)), pa.array(["a" * 50, None, "", "b" * 19, "c", "d" * 20, "e"])], names=["i", "t"])
    pieces = list(bytewords.sliced(batch.slice(1), 1, 3))
    assert [p.column(0).to_pylist() for p in pieces] == [[1, 2, 3], [4], [5], [6]]
    assert not list(bytewords.sliced(batch.slice(0, 0), 1))


# Search


def brute_search(docs, queries, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def as_rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def query_table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 9) for i, t in rows], "item_id long, text string, doc_id long, terms string, score long")


@pytest.mark.parametrize(("slice_bytes", "query_terms"), [(200, 200_000), (4000, 5)])
def test_search_is_exact_over_blocks(spark, monkeypatch, slice_bytes, query_terms):
    monkeypatch.setattr(bytewords, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", query_terms)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, weights=range(1, 61), k=rng.choice([1, 5, 40, 300])))) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)]  # more copies than results
    queries = [(q, " ".join(rng.sample(vocab, rng.randrange(1, 20)))) for q in range(12)] + [(3, docs[7][1]), (None, "w59 w59 W1")]
    got = lexical_search.search(lexical_search.build(table(spark, [(*d, None, None) for d in docs]).repartition(3)), query_table(spark, queries), k=10)
    assert as_rows(got) == sorted(brute_search(docs, queries, 10), key=repr)


def test_search_edges(spark, edge, empty):
    queries = [(1, "one two"), (2, None), (3, ""), (4, "ñandú word5x5 missing"), (5, "a" * 300), (1, "one two")]
    got = lexical_search.search(lexical_search.build(edge), query_table(spark, queries))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert as_rows(got) == sorted(brute_search([(r[0], r[1]) for r in EDGE], queries, 50), key=repr)
    assert as_rows(got)[-1][2] is not None and any(r[2] is None for r in as_rows(got))
    none = lexical_search.build(empty)
    assert (none.n_docs, none.n_terms) == (0, 0)
    assert lexical_search.search(none, query_table(spark, queries)).count() == 0
    assert lexical_search.search(lexical_search.build(edge), query_table(spark, [])).count() == 0


def test_bounds_hold_and_few_documents_are_rescored():
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 50, 5000), rng.integers(50, 10**7, 5000)
    exact = lexical_search.impacts(tf, n, 10**6, 10**9)
    byte = -(-exact // lexical_search.STEP)
    assert byte.max() <= 255 and (exact <= byte * lexical_search.STEP).all() and (exact[byte > 0] > (byte[byte > 0] - 1) * lexical_search.STEP).all()


# Importance


def brute_resample(docs, targets, percent=25, least=20):
    def features(t):
        w = terms(t)
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    s, t = (collections.Counter(f for x in texts for f in features(x)) for texts in ([x for _, x in docs], targets))
    s_all, t_all = sum(s.values()), sum(t.values())
    scored = []
    for i, x in docs:
        own = features(x)
        gain = [math.floor(1000 * math.log((t[f] + 1) * (s_all + 10_000) / ((s[f] + 1) * (t_all + 10_000)))) for f in own]
        weight = sum(gain) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(terms(x))))
    able = sorted((-x[3], x[0] is not None, x[0] or 0) for x in scored if x[4] >= least)
    drawn = collections.defaultdict(list)
    for r, (_, has, i) in enumerate(able[: percent * len(able) // 100]):
        drawn[i if has else None].append(r + 1)
    return [(i, n, w, x, drawn[i].pop(0) if words >= least and drawn[i] else None) for i, n, w, x, words in scored]


def resampled(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_resampling_is_the_brute_force_one(spark):
    rng = random.Random(8)
    vocab = [f"W{i}é" for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 19, 20, 60])))) for i in range(400)]
    targets = [" ".join(vocab[:40])] * 3 + [None]
    got = importance.resample(table(spark, [(*d, None, None) for d in docs]).repartition(5), query_table(spark, list(enumerate(targets))))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert resampled(got) == sorted(brute_resample(docs, targets), key=repr)


def test_resampling_edges(spark, edge, empty):
    targets = ["word1x1 one", None]
    docs = [(r[0], r[1]) for r in EDGE]
    got = resampled(importance.resample(edge, query_table(spark, list(enumerate(targets))), percent=60, least_words=1))
    want = sorted(brute_resample(docs, targets, 60, 1), key=repr)
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] or 0 for r in got) == sorted(r[4] or 0 for r in want)
    assert importance.resample(empty, query_table(spark, [])).count() == 0
    few = importance.resample(edge, query_table(spark, []), least_words=10**9).collect()
    assert len(few) == len(EDGE) and {r["rank"] for r in few} == {None}


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 37 % 11).alias("x"))
    got = importance.numbered(rows.repartition(7), F.col("x").desc(), F.col("id").asc()).collect()
    want = sorted(((r.x, r.id) for r in got), key=lambda r: (-r[0], r[1]))
    assert [(r.x, r.id) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 5001))


# N-gram join


def joined(df, **args):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_components(df, **args).collect()}


@pytest.mark.parametrize("width", [1, 2, 5])
def test_join_is_exact(spark, width):
    rng = random.Random(width)
    rows = [*near_copies(60, 1), *near_copies(25, 2), (1, "a"), (2, "A"), (3, "a b"), (4, "x y z"), (5, ""), (6, None)]
    for i in range(60):  # sizes near the threshold
        words = [f"s{j}" for j in range(rng.randrange(40, 56))]
        rng.shuffle(words) if width == 1 else None
        rows.append((9000 + i, " ".join(words)))
    assert joined(table(spark, [(i, t, None, None) for i, t in rows]), width=width) == brute_components(rows, width)


def test_join_of_documents(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op13_ngram_join"](spark, SF).collect()}
    assert got == brute_components(documents(spark), 5)


def test_join_edges(spark, edge, empty):
    rows = ngram_join.join_components(edge, width=2).collect()
    assert len(rows) == len(EDGE)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add(r.component_id)
    assert got[4] == {4} and got[5] == {4} and got[8] == {7} and got[11] == {11} and got[2] == {2} and got[None] == {4, None}
    assert ngram_join.join_components(empty).count() == 0


def test_prefixes_lose_no_pair():
    for n in range(1, 300):
        for m in range(n, n * 100 // near_duplicates.PERCENT + 1):
            least = -(-4 * (n + m) // 9)  # the least overlap of a pair of these sizes at 0.8
            assert n - least + 1 <= ngram_join.lead_prefix(n) and m - least + 1 <= ngram_join.whole_prefix(m)
            assert ngram_join.bitmaps_close(n + m - 2 * least, n, m)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(3)
    for size in (10, 300, 9000):
        common, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (size, size // 5, size // 7))
        x, y = (np.unique(np.concatenate([common, own])) for own in (a, b))
        bits = int(np.bitwise_count((ngram_join.bitmap(x) ^ ngram_join.bitmap(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y))


def test_bitmaps_tell_large_sets_apart():
    rng = np.random.default_rng(4)
    for n in (450, 6000, 40_000):
        common = rng.integers(0, 1 << 63, n // 2, np.uint64)
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, size, np.uint64)])) for size in (n // 2, n // 2, n // 4)]
        found = near_duplicates._Sketches(pa.chunked_array([pa.array([ngram_join.bitmap(s) for s in sets], pa.list_(pa.int64()))]))
        for i, x in enumerate(sets):
            near = np.array([j for j in range(3) if j != i])
            bits = found.differing(i, near)
            assert all(b <= len(np.setxor1d(x, sets[j])) for b, j in zip(bits, near, strict=True))
            assert not any(ngram_join.bitmaps_close(b, len(x), len(sets[j])) for b, j in zip(bits, near, strict=True))


def test_folded_bitmaps_are_those_of_fewer_bits(spark):
    rng = np.random.default_rng(5)
    x, y = (np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (500, 530))
    a, b = ngram_join.bitmap(x), ngram_join.bitmap(y)
    assert 2 * len(a) == len(b)
    want = int(np.bitwise_count((a ^ b[: len(a)] ^ b[len(a) :]).view(np.uint64)).sum())
    assert want <= len(np.setxor1d(x, y))
    sketches = near_duplicates._Sketches(pa.chunked_array([pa.array([a, b], pa.list_(pa.int64()))]))
    assert sketches.differing(0, np.array([1])).tolist() == sketches.differing(1, np.array([0])).tolist() == [want]
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
    assert row.select(near_duplicates._differing("a", "b"), near_duplicates._differing("b", "a"), near_duplicates._differing("b", "b")).first()[:] == (want, want, 0)


def test_linked_sets_share_as_many_buckets_as_needed():
    rng = random.Random(6)
    for _ in range(4000):
        n = rng.randrange(1, 90)
        m = rng.randrange(n, n * 100 // near_duplicates.PERCENT + 1)
        least = -(-4 * (n + m) // 9)
        if least > n:
            continue
        order = list(range(n + m - least))  # the least overlap, in any order of the shingles
        rng.shuffle(order)
        if rng.random() < 0.5:  # or the shared ones as late as some others allow
            order.sort(key=lambda k: rng.random() + (0.9 if k < least else 0))
        small = [k for k in order if k < n]
        large = [k for k in order if k < least or k >= n]
        shared = set(small[: ngram_join.lead_prefix(n)]) & set(large[: ngram_join.whole_prefix(m)])
        assert len(shared) >= ngram_join.least_shared(m, n) and len(large) == m


@pytest.mark.parametrize("small", [2, 5, 1000])
def test_links_are_found_in_buckets_of_any_size(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "STAR_PART", 1 << 40)  # no bucket has a centre
    monkeypatch.setattr(near_duplicates, "SMALL_BUCKET", small)
    rng = random.Random(small)
    rows = near_copies(30, 4)
    for i in range(90):  # families near the threshold, of sizes that differ in their bitmaps' lengths
        words = [f"f{i % 9}w{j}" for j in range(rng.randrange(225, 280))]
        for j in rng.sample(range(len(words)), rng.randrange(30)):
            words[j] = f"o{rng.randrange(10**9)}"
        rows.append((9000 + i, " ".join(words)))
    assert joined(table(spark, [(i, t, None, None) for i, t in rows]), width=1) == brute_components(rows, 1)


def test_batches_end_inside_buckets():
    rng = np.random.default_rng(7)
    bucket = np.sort(rng.integers(0, 60, 400))
    columns = [bucket, np.arange(400), rng.integers(0, 300, 400), rng.integers(60, 120, 400), rng.random(400) < 0.5]
    whole = pa.record_batch([pa.array(x) for x in columns], names=["bucket", "node", "c", "n", "lead"])
    found = []
    for length in (1, 7, 400):
        batches = [whole.slice(at, length) for at in range(0, 400, length)]
        found.append(sorted(tuple(r.values()) for x in near_duplicates._pairs_within(ngram_join.least_shared)(iter([whole.slice(0, 0), *batches])) for r in x.to_pylist()))
    want = [
        (i, j) if (n[i], i) > (n[j], j) else (j, i)
        for _, _, c, n, lead in [columns]
        for i in range(400)
        for j in range(i)
        if bucket[i] == bucket[j] and c[i] != c[j] and (lead[i] or lead[j]) and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
    ]
    assert found[0] == found[1] == found[2] and [r[:2] for r in found[0]] == sorted(want)


def test_long_texts_with_little_in_common_send_no_sets(spark, monkeypatch):
    staged = collections.Counter()
    stage = near_duplicates.stage_table

    def counted(df, label, *args, **kw):
        out = stage(df, label, *args, **kw)
        staged[label] += out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stage_table", counted)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{k}" for k in rng.sample(range(30_000), 6000)), None, None) for i in range(40)]
    assert ngram_join.join_components(table(spark, rows), width=1).where("component_id <> doc_id").count() == 0
    assert staged["bucket-members"] and not staged["near-sets"] and not staged["near-candidates"], staged


def test_what_the_join_stages_is_dropped(spark):
    from claimlens.llm import tables

    start = tables.staged_so_far()
    rows = near_copies(40, 9)
    cleanup = spark.conf.get(tables._CLEANUP, None)
    assert joined(table(spark, [(i, t, None, None) for i, t in rows]), width=2) == brute_components(rows, 2)
    left = [p for p, _ in tables._STAGED.tables[start:] if p]
    assert not [p for p in left if re.search("/(signatures|near-sets|open-nodes|near-candidates)-", p)]
    assert spark.conf.get(tables._CLEANUP, None) == cleanup


def test_links_of_the_join_without_centres_are_found(spark, monkeypatch):
    linked = near_duplicates._linked
    monkeypatch.setattr(near_duplicates, "_linked", lambda pairs, *rest, **close: linked(pairs.limit(0), *rest, **close))
    monkeypatch.setattr(near_duplicates, "TILE_NODES", 7)
    monkeypatch.setattr(near_duplicates, "BLOCK_WEIGHT", 5000)
    rows = near_copies(40, 3)
    assert joined(table(spark, [(i, t, None, None) for i, t in rows]), width=2) == brute_components(rows, 2)


def templates(n):
    """Pages of which half the words are a template."""
    rng = random.Random(n)
    base = [f"t{i}" for i in range(60)]
    return [(i, " ".join(base + [f"p{rng.randrange(10**9)}" for _ in range(60)]), None, None) for i in range(n)]


@pytest.mark.parametrize("method", ["minhash", "join"])
def test_templates_do_not_grow_as_squares(spark, monkeypatch, method):
    counts = collections.Counter()
    stage = near_duplicates.stage_table

    def counted(df, label, *args, **kw):
        out = stage(df, label, *args, **kw)
        counts[label, now] += out.count()
        return out

    tiles = near_duplicates._tiles

    def counted_tiles(*args):
        out = tiles(*args)
        counts["tiles", now] += out.count()
        return out

    monkeypatch.setattr(near_duplicates, "stage_table", counted)
    monkeypatch.setattr(near_duplicates, "_tiles", counted_tiles)
    for now in (2000, 4000):
        df = table(spark, templates(now))
        got = near_duplicates.near_components(df, width=2) if method == "minhash" else ngram_join.join_components(df, width=2)
        assert got.where("component_id <> doc_id").count() == 0
    for label in ("tiles", "near-candidates", "near-late", "open-members", "bucket-members"):
        assert counts[label, 4000] <= 2.5 * counts[label, 2000] + 200, counts
    assert counts["near-late", 4000] == 0


# Language models


def test_models_grow_in_proportion_to_their_grams():
    from claimlens.llm import language_id

    rng = random.Random(2)
    sizes = {}
    for n in (8, 16, 32, 64):
        rows, grams = [], 0
        for lang in range(n):
            words = {"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 7))): 1 for _ in range(600)}
            sample = pa.table({"word": list(words), "n": list(words.values())})
            own = language_id._learned((pa.scalar(f"l{lang:02}"),), sample).to_pylist()
            grams += sum(len(r["h"]) // 8 for r in own)
            rows += own
        models = language_id._assembled(rows)
        assert models.nbytes <= grams * (8 + 8 * language_id.BLOCK) and len(models.blocks) == n // language_id.BLOCK
        sizes[n] = models.nbytes
    assert sizes[64] <= 2.2 * sizes[32] <= 4.84 * sizes[16] <= 10.7 * sizes[8]


def test_blocks_of_languages_change_no_score(monkeypatch):
    from claimlens.llm import language_id

    rng = random.Random(3)
    rows = []
    for lang in range(11):
        words = {"".join(rng.choices("abcdefgé"[: 4 + lang % 5], k=rng.randrange(1, 7))): rng.randrange(1, 4) for _ in range(80)}
        rows += language_id._learned((pa.scalar(f"l{lang:02}"),), pa.table({"word": list(words), "n": list(words.values())})).to_pylist()
    texts = ["abc dea", None, "", "12", "é gab abc abc", "zzz"]
    found = []
    for block in (1, 8, 64):
        monkeypatch.setattr(language_id, "BLOCK", block)
        found.append(language_id._assembled(rows).entropies(texts))
    for h, length, letters in found[1:]:
        assert np.allclose(h, found[0][0]) and (length == found[0][1]).all() and (letters == found[0][2]).all()


# Staged tables


def test_threads_drop_only_what_they_staged(spark):
    import os
    import threading

    from claimlens.llm import tables

    held, ready, go = {}, threading.Barrier(2), threading.Event()

    def work(name):
        start = tables.staged_so_far()
        held[name] = [tables.stage_table(spark.range(3), "thread"), tables.stage_buckets(spark.range(3), "thread", "id", 2)]
        paths = [p.removeprefix("file:") for p, _ in tables._STAGED.tables[start:]]
        ready.wait()
        if name == "a":
            tables.drop_staged(spark, start, tables.staged_so_far())
            go.set()
        go.wait()
        held[name] = [os.path.exists(p) for p in paths]
        if name == "b":
            tables.drop_staged(spark, start, tables.staged_so_far())
            held["after"] = [os.path.exists(p) for p in paths]

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held == {"a": [False, False], "b": [True, True], "after": [False, False]}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("thread_")]
