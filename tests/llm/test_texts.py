"""Near-duplicates, classifiers, language model, repeated passages and packing, against brute force."""

import collections
import hashlib
import math
import random
import re
import string
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from claimlens.llm import language_id, near_duplicates, packing, pitman_yor, quality_classifier, suffix_dedup
from claimlens.llm.calibration import isotonic
from claimlens.llm.components import components
from claimlens.llm.queries import QUERIES
from tests.llm.conftest import EDGE, table

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def rest(i, n):
    return zlib.crc32(str(i).encode()) % n


# Near-duplicates


def grams(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width):
    sets = {i: grams(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((1000 * seed + i, " ".join(words)))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_are_exact(spark, width):
    rows = [*near_copies(60, 1), *near_copies(25, 2), (1, "a"), (2, "A"), (3, "a b"), (4, "x y z"), (5, ""), (6, None)]
    got = near_duplicates.near_components(table(spark, [(i, t, None, None) for i, t in rows]), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_links_between_outsiders_are_found(spark, monkeypatch):
    # With no confirmed centre links, all has to come from the meeting of clusters.
    linked = near_duplicates._linked
    monkeypatch.setattr(near_duplicates, "_linked", lambda pairs, classes, sets: linked(pairs.limit(0), classes, sets))
    monkeypatch.setattr(near_duplicates, "BLOCK_WEIGHT", 5000)
    rows = near_copies(40, 3)
    got = near_duplicates.near_components(table(spark, [(i, t, None, None) for i, t in rows]), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2)


def test_links_stay_few_in_a_large_group(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(3000):
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), None, None))
    counts = []

    def counted(links):
        out = components(links)
        counts.append(links.count())
        return out

    monkeypatch.setattr(near_duplicates, "components", counted)
    got = near_duplicates.near_components(table(spark, rows), width=2).collect()
    assert {r.component_id for r in got} == {0} and sum(counts) <= 6 * len(rows)


def test_an_id_with_two_texts_stands_in_two_components(spark):
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    texts = [(1, x), (1, y), (2, [*x[:-1], "z"]), (3, [*y[:-1], "z"]), (4, x[:-2]), (4, ["other"])]
    df = table(spark, [(i, " ".join(w), None, None) for i, w in texts])
    assert sorted(r.component_id for r in near_duplicates.near_components(df, width=2).collect()) == [1, 1, 1, 1, 1, 4]
    assert sorted((r.doc_id, r.text[0]) for r in near_duplicates.drop_near_copies(df, width=2).collect()) == [(1, "x"), (1, "y"), (4, "o")]


def test_near_duplicates_of_documents(spark):
    got = QUERIES["op2_near_duplicates"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(documents(spark), 2)


def test_near_duplicate_edges(spark, edge, empty):
    rows = near_duplicates.near_components(edge, width=2).collect()
    assert len(rows) == len(EDGE)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.component_id, r.kept))
    assert got[4] == {(4, True)} and got[5] == {(4, False)} and got[8] == {(7, False)} and got[11] == {(11, True)} and got[2] == {(2, True)}
    assert got[None] == {(4, False), (None, True)}
    assert near_duplicates.near_components(empty).count() == 0
    kept = near_duplicates.drop_near_copies(edge, width=2)
    assert kept.columns == edge.columns and not {5, 8} & {r.doc_id for r in kept.collect()}


def test_sketches_estimate_similarity():
    samples = near_duplicates._Samples()
    rng = random.Random(1)
    for share in (0.7, 0.8, 0.9):
        a = [f"w{rng.randrange(10**9)}" for _ in range(1500)]
        b = [w if rng.random() < 2 * share / (1 + share) else f"v{i}" for i, w in enumerate(a)]
        x, y = (near_duplicates.shingles(" ".join(t), 1) for t in (a, b))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        odd = int(np.bitwise_count(samples.sketch(samples.of(x)).view(np.uint64) ^ samples.sketch(samples.of(y)).view(np.uint64)).sum())
        n, k = 64 * near_duplicates.SKETCH_WORDS, near_duplicates.SAMPLES
        assert abs(1 + n / (4 * k) * math.log(1 - 2 * odd / n) - true) < 0.08


def test_component_labels(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (200, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Classifiers


def test_quality_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(r.held_out == (rest(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and i in labels]
    assert sum(a == b for a, b in held) >= 0.99 * len(held)


def plain_statistics(text):
    """The classifier's statistics of a text, counted by patterns."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(raw))

    def times(pattern):
        return len(re.findall(pattern, raw))

    upper, marks = times(rb"[A-Z]"), sum(c in string.punctuation.encode() for c in raw)
    return [
        math.log(1 + len(raw)),
        math.log(1 + len(words)),
        min(20, (size - times(b" ")) / n),
        upper / max(1, times(rb"[A-Za-z]")),
        times(rb"[0-9]") / size,
        min(1, marks / n / 4),
        min(2, times(rb"[#*$%&|<>]") / n),
        min(2, times(b"!") / n),
        len(set(words)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log(1 + n / max(1, len(lines))),
        times(rb"[\x80-\xff]") / size,
        min(1, times(rb"[,.]") / n),
        0 if words else 1,
    ]


def test_quality_scores_are_those_of_a_plain_fit(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(documents(spark, sf))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    tune = F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(4)) == 0
    aside = {r.doc_id: r.tune for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", tune.alias("tune")).collect()}
    learned = [i for i in texts if i in labels and rest(i, 5)]
    x = {i: plain_statistics(t) for i, t in texts.items()}

    fitted = np.array([x[i] for i in learned if not aside[i]])
    mean, scale = fitted.mean(axis=0), np.maximum(fitted.std(axis=0), 0.05)
    rng = np.random.default_rng(quality_classifier.SEED)
    size = quality_classifier.FEATURES
    waves, shift = rng.normal(0, math.sqrt(2 * quality_classifier.GAMMA), (len(mean), size)), rng.uniform(0, 2 * math.pi, size)

    def features(rows):
        bent = 2 * np.tanh((np.array(rows) - mean) / scale / 2)
        return np.array([np.append(math.sqrt(2 / size) * np.cos(r @ waves + shift), 1) for r in bent])

    # Ridge regression as least squares over all rows and one more for each weight.
    z = features(fitted)
    target = np.array([labels[i] for i in learned if not aside[i]] + [0] * (size + 1))
    weights = np.linalg.lstsq(np.vstack([z, math.sqrt(quality_classifier.RIDGE) * np.eye(size + 1)]), target, rcond=None)[0]
    raw = dict(zip(x, np.clip(features(list(x.values())) @ weights, -0.5, 1.5), strict=True))

    # The isotonic fit by its min-max formula, over the same bins.
    bins = collections.defaultdict(list)
    for i in learned:
        if aside[i]:
            bins[min(quality_classifier.BINS - 1, int((raw[i] + 0.5) / 2 * quality_classifier.BINS))].append((raw[i], labels[i]))
    cells = [bins[b] for b in sorted(bins)]

    def rate(a, b):
        ys = [y for cell in cells[a : b + 1] for _, y in cell]
        return sum(ys) / len(ys)

    level = [max(min(rate(a, b) for b in range(k, len(cells))) for a in range(k + 1)) for k in range(len(cells))]
    blocks = [[v for cell, at in zip(cells, level, strict=True) if at == one for v in cell] for one in sorted(set(level))]
    knots = [sum(r for r, _ in b) / len(b) for b in blocks]
    rates = np.maximum.accumulate([(sum(y for _, y in b) + 0.5) / (len(b) + 1) for b in blocks])

    got = {r.doc_id: r.score for r in QUERIES["op3_quality_classifier"](spark, sf).collect()}
    assert set(got) == set(texts) and len(blocks) > 1
    for i, r in raw.items():
        assert abs(got[i] - np.clip(0.99 * np.interp(r, knots, rates) + 0.01 * (r + 0.5) / 2, 0, 1)) < 1e-4


def test_quality_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(edge, none).collect()} == {0.5}
    odd = spark.createDataFrame([(7, 1), (4, 0), (9, 1), (13, 0), (14, None), (6, 1), (10, 0), (3, 0)], "doc_id long, quality int")
    rows = quality_classifier.score(edge, odd).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 11}) == 1
    assert quality_classifier.score(empty, odd).count() == 0


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 5, 1, 10.0]), np.array([10, 10, 10, 10.0]))
    assert (np.diff(y) > 0).all() and len(x) == 3
    assert isotonic(np.zeros(0), np.zeros(0), np.zeros(0))[1][0] == 0.5


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, sf).collect()
    assert len(rows) == len(langs) and all(r.held_out == (rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.98 * len(held)


def test_language_edges(spark, edge, empty):
    assert {r.lang_pred for r in language_id.identify(edge, None).collect()} == {"und"}
    models = language_id.fit(edge)
    rows = language_id.identify(edge, models).collect()
    assert len(rows) == len(EDGE)
    got = {r.doc_id: r for r in rows if r.doc_id}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3)) and got[4].lang_pred != "und"
    assert language_id.fit(empty) is None and language_id.identify(empty, models).count() == 0
    digits = table(spark, [(1, "123 456 !!", None, None)])
    assert language_id.identify(digits, models).first().lang_pred == "und"


def test_every_language_keeps_a_text_to_learn_from(spark):
    tune = F.pmod(F.xxhash64(F.lit("tune"), "id"), F.lit(4)) == 0
    ids = [r.id for r in spark.range(10_000).where(tune).collect() if rest(r.id, language_id.HOLDOUT)]
    # One text, put aside by its hash; only a text without letters beside it; one that is longer than the sample by far.
    rows = [(ids[0], "uno dos tres", "es", None), (ids[1], "eins zwei drei", "de", None), (ids[2], "12 34", "de", None), (ids[3], "123 " * 20_000 + "ett två tre " * 100_000, "sv", None)]
    assert set(language_id.fit(table(spark, rows), sample_chars=1).languages) == {"es", "de", "sv"}


def test_three_hundred_languages_are_learned(spark, monkeypatch):
    rng = random.Random(8)
    alphabet = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(10 * k + i, " ".join("".join(rng.choices(alphabet[10 * k : 10 * k + 10], k=6)) for _ in range(8)), f"l{k:03}", None) for k in range(300) for i in range(4)]
    models = language_id.fit(table(spark, rows), sample_chars=2000)
    assert len(models.languages) == len({r[2] for r in rows if rest(r[0], 5)})
    got = language_id.identify(table(spark, rows), models).collect()
    langs = {r[0]: r[2] for r in rows}
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.97 * len(got)


def test_samples_fill_their_budget(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE_CHARS", 10)
    rows = [(lang, i * 2654435761 * (1 << 31) % (1 << 64) - (1 << 63) if lang == "a" else i, 10) for lang in "ab" for i in range(500)]
    pieces = spark.createDataFrame([*rows, ("c", 5, 10)], "lang string, h long, chars long")
    got = language_id._limits(pieces, ["a", "b", "c"], 1234)
    for lang in "ab":
        assert sum(n for x, h, n in rows if x == lang and h <= got[lang]) == 1230
    assert got["c"] == (1 << 63) - 1


def test_character_models_are_distributions(spark):
    words = {"abba": 3, "abc": 2, "cab": 1, "b": 5}
    orders, _ = language_id._train(words)
    letters = {g for g in orders[0]["p"]}
    for order in range(2, language_id.ORDER + 1):
        for context, weight in orders[order - 1]["w"].items():
            total = 0.0
            for c in letters:
                p = orders[order - 1]["p"].get(context + c)
                if p is None:
                    p, h = weight, context[1:]
                    while h and (h + c) not in orders[len(h)]["p"]:
                        p, h = p * orders[len(h)]["w"].get(h, 1.0), h[1:]
                    p *= orders[len(h)]["p"].get(h + c, 0)
                total += p
            assert total <= 1 + 1e-9


class PlainModel:
    """Interpolated Kneser-Ney over the characters of words, straight from its definition."""

    def __init__(self, words, order, discount):
        self.d, padded = discount, [f" {w} " for w in words]
        grams = [w[i : i + order] for w in padded for i in range(len(w) - order + 1)]
        self.levels = {order: collections.Counter(grams)}
        for m in range(order - 1, 0, -1):
            # One for each different character before a gram, and all that stand at the beginning of words.
            before = collections.Counter(g[1:] for g in self.levels[m + 1])
            self.levels[m] = before + collections.Counter(w[:m] for w in padded if m > 1 and len(w) >= m)
        self.size = len(self.levels[1]) + 1

    def probability(self, context, char):
        same = [n for g, n in self.levels[len(context) + 1].items() if g[:-1] == context]
        lower = self.probability(context[1:], char) if context else 1 / self.size
        if not same:
            return lower
        n = self.levels[len(context) + 1][context + char]
        return max(n - self.d, 0) / sum(same) + self.d * len(same) / sum(same) * lower

    def entropy(self, words, order):
        padded = [f" {w} " for w in words]
        logs = [math.log(self.probability(w[max(0, i - order + 1) : i], w[i])) for w in padded for i in range(1, len(w))]
        return -sum(logs) / len(logs)


def test_languages_are_those_of_plain_models(spark):
    rng = random.Random(3)
    order, discount = language_id.ORDER, language_id.DISCOUNT
    learned = {lang: ["".join(rng.choices(letters, k=rng.randrange(1, 8))) for _ in range(60)] for lang, letters in (("aa", "abcde"), ("bb", "abcdxyé"), ("cc", "eeeéxst"))}
    rows = []
    for lang, words in learned.items():
        counts = collections.Counter(words)
        sample = pa.table({"word": list(counts), "n": list(counts.values())})
        rows += language_id._learned((pa.scalar(lang),), sample).to_pylist()
    models = language_id._assembled(rows)
    plain = {lang: PlainModel(words, order, discount) for lang, words in learned.items()}
    texts = [" ".join("".join(rng.choices("abcdexyéstq", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    found, _, _ = models.entropies(texts)
    want = np.array([[plain[lang].entropy(t.split(), order) for lang in models.languages] for t in texts])
    assert np.abs(found - want).max() < 1e-4
    got = {r.doc_id: r.lang_pred for r in language_id.identify(table(spark, [(i, t, None, None) for i, t in enumerate(texts)]), models).collect()}
    clear = [i for i in range(len(texts)) if np.diff(np.sort(want[i]))[0] > 1e-3]
    assert len(clear) > 50 and all(got[i] == models.languages[want[i].argmin()] for i in clear)


# Language model


def test_base_scores_are_exact(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_pitman_yor"](spark, SF).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in documents(spark)}
    c = collections.Counter(w for i, ws in tokens.items() if rest(i, 10) for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(rows) == set(tokens)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, rest(i, 10) == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark, edge, empty):
    rows = pitman_yor.score(edge).collect()
    assert len(rows) == len(EDGE) and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert len({r.score for r in rows if r.doc_id == 11}) == 1
    assert pitman_yor.score(empty).count() == 0
    alone = pitman_yor.score(table(spark, [(next(i for i in range(99) if rest(i, 10) == 0), "a b", None, None)])).first()
    assert (alone.train_tokens, alone.score, alone.base_score) == (0, 0.0, 0.0)


@pytest.mark.parametrize("part_tokens", [40, 10**6])
def test_language_model_is_a_distribution(spark, part_tokens):
    """Over the training words and one unknown word, the probabilities after a word add up to one."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    train = [(i, " ".join(rng.choices(words, weights=range(1, 13), k=20)), None, None) for i in range(60) if rest(i, 10)]
    held = [i for i in range(1000, 3000) if rest(i, 10) == 0][:13]
    ask = [(i, f"w3 {w}", None, None) for i, w in zip(held, [*words, "unknown"], strict=True)]
    one = next(i for i in range(3000, 4000) if rest(i, 10) == 0)
    got = {r.doc_id: r.score for r in pitman_yor.score(table(spark, train + ask + [(one, "w3", None, None)]), part_tokens=part_tokens).collect()}

    # The last token of "w3 w" is the end after w, so the sums fall short of the whole by what ends later.
    assert 0 < sum(10 ** got[i] for i in held) + 10 ** got[one] < 1


@pytest.mark.parametrize("part_tokens", [150, 10**6])
def test_every_word_has_a_context_of_its_own(spark, part_tokens):
    # Two words that share a class among 16,384.
    classes = {}
    for i in range(10_000):
        h = np.array([pitman_yor.xxhash.xxh3_64_intdigest(f"c{i}".encode())], np.uint64)
        a, b = classes.setdefault(int(pitman_yor._mixed(h)[0]) % 16_384, f"c{i}"), f"c{i}"
        if a != b:
            break
    train = [(i, f"{a} x" if i % 2 else f"{b} y", None, None) for i in range(200) if rest(i, 10)]
    held = [i for i in range(1000, 2000) if rest(i, 10) == 0][:4]
    ask = [(i, t, None, None) for i, t in zip(held, (f"{a} x", f"{a} y", f"{b} x", f"{b} y"), strict=True)]
    got = {r.doc_id: r.score for r in pitman_yor.score(table(spark, train + ask), part_tokens=part_tokens).collect()}
    ax, ay, bx, by = (got[i] for i in held)
    assert ax > ay + 1 and by > bx + 1


def part_of(count):
    """A part that holds the dishes of count (contexts by words)."""
    contexts, words = count.shape
    pack = pitman_yor._pack
    u64, u32 = (lambda k: pack(np.arange(1, k + 1, dtype=np.uint64))), (lambda x: pack(x.ravel().astype(np.uint32)))
    context, word = np.meshgrid(np.arange(contexts), np.arange(words), indexing="ij")
    none = np.empty(0, np.uint64)
    row = {"part": 0, "words": u64(words), "contexts": u64(contexts), "dish_word": u32(word), "dish_context": u32(context), "dish_count": u32(count)}
    return pitman_yor._Part(row, pitman_yor.Split(none, none, none.astype(int), none))


def test_predictions_add_up():
    """Over all words and one unknown word, a context's predictive probabilities are a distribution."""
    rng = np.random.default_rng(2)
    contexts, words = 7, 50
    count = np.hstack([rng.poisson(2.0, (contexts, words)), np.zeros((contexts, 1), int)])
    tables = np.minimum(count, 1 + rng.poisson(0.5, count.shape)) * (count > 0)
    seats, part = np.minimum(tables.sum(0), 1), part_of(count)
    root = pitman_yor.Root(tables.sum(0), seats, tables.sum(), seats.sum(), words)
    for hot in (False, True):
        shared = {"context_count": np.array([count[0].sum()]), "context_tables": np.array([tables[0].sum()]), "hot_count": count[0, :1], "hot_tables": tables[0, :1]}
        if hot:  # The first context is split over parts, its first dish by documents too: the part holds a share, the whole is shared.
            part.heavy, part.hot = np.where(np.arange(contexts) == 0, 0, -1), np.where(np.arange(count.size) == 0, 0, -1)
            part.count[0] //= 2
        p = part.predictive(np.where(part.hot < 0, tables.ravel(), 0), root, shared).reshape(count.shape)
        assert np.allclose(p.sum(axis=1), 1.0)


def openings(n, weight, discount):
    """The exact distribution of a dish's number of tables, over all ways to open them."""
    ways = {1: 1.0}
    for k in range(1, n):
        more = collections.defaultdict(float)
        for t, p in ways.items():
            more[t] += p * (k - discount * t)
            more[t + 1] += p * weight(t)
        ways = more
    total = sum(ways.values())
    return np.array([ways.get(t, 0.0) / total for t in range(n + 1)])


@pytest.mark.parametrize(("n", "asked"), [(2, 1 << 18), (3, 1 << 18), (7, 1 << 18), (48, 1 << 18), (48, 32), (90, 40)])
def test_seats_have_the_exact_distribution(monkeypatch, n, asked):
    """Also past the customers that are asked one by one."""
    monkeypatch.setattr(pitman_yor, "EXACT", asked)
    weight = lambda t: (1 + 0.75 * (2 + t)) * (0.4 + t) / (9 + t)
    rng = np.random.default_rng(n)
    dishes = 20_000
    seats = pitman_yor.seat(rng, np.full(dishes, n), lambda _, t: weight(t), 0.75)
    for _ in range(80):
        seats = pitman_yor.seat(rng, np.full(dishes, n), lambda _, t: weight(t), 0.75, seats)
    got = np.bincount(seats.tables(), minlength=n + 1) / dishes
    assert np.abs(got - openings(n, weight, 0.75)).max() < 0.012


@pytest.mark.parametrize("asked", [1 << 18, 100])
def test_drawing_at_once_is_asking_each(monkeypatch, asked):
    """Without the test for the order of drawing: many customers, against one after the other."""
    monkeypatch.setattr(pitman_yor, "EXACT", asked)
    rng = np.random.default_rng(5)
    n, dishes, w = 300, 4000, 3.0
    at_once = pitman_yor.seat(rng, np.full(dishes, n), lambda _, t: np.full(len(t), w), 0.6).tables()
    t = np.ones(dishes)
    for k in range(1, n):
        t += rng.random(dishes) * (k - 0.6 * t + w) < w
    assert abs(at_once.mean() - t.mean()) < 0.25 and abs(at_once.std() / t.std() - 1) < 0.06


def brute_gibbs(count, sweeps, rng):
    """Averaged predictive probabilities from a plain sampler that moves one customer at a time, tables with their sizes."""
    contexts, words = count.shape
    d, s, d0, s0 = pitman_yor.DISCOUNT, pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_STRENGTH
    known = int((count.sum(0) > 0).sum())
    room = [[[] for _ in range(words)] for _ in range(contexts)]
    top = [[] for _ in range(words)]

    def root_p(w):
        t, n = sum(map(len, top)), sum(map(sum, top))
        return (sum(top[w]) - d0 * len(top[w]) + (s0 + d0 * t) / (known + 1)) / (s0 + n)

    def sit(tables, weight, discount):
        share = [x - discount for x in tables] + [weight]
        k = rng.choices(range(len(share)), share)[0]
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            return True
        return False

    def add(c, w):
        if sit(room[c][w], (s + d * sum(map(len, room[c]))) * root_p(w), d):
            sit(top[w], (s0 + d0 * sum(map(len, top))) / (known + 1), d0)

    customers = [(c, w) for c in range(contexts) for w in range(words) for _ in range(count[c, w])]
    for c, w in customers:
        add(c, w)
    total = np.zeros(count.shape)
    for _ in range(sweeps):
        for c, w in customers:
            if leave(room[c][w]):
                leave(top[w])
            add(c, w)
        root = np.array([root_p(w) for w in range(words)])
        tables = np.array([[len(x) for x in r] for r in room])
        total += (count - d * tables + (s + d * tables.sum(1)[:, None]) * root) / (s + count.sum(1)[:, None])
    return total / sweeps


def test_sweeps_agree_with_a_plain_sampler():
    """To 0.02, as a sweep's restaurants see each other's new tables in the root only in the next one."""
    count = np.array([[6, 3, 0, 1], [0, 9, 2, 1], [4, 0, 0, 2]])
    want = brute_gibbs(count, 3000, random.Random(1))
    part, rng = part_of(count), np.random.default_rng(1)
    words, known = count.sum(0), 4
    root = pitman_yor.Root(words, np.minimum(words, 1), words.sum(), known, known)
    shared = {k: np.empty(0, int) for k in ("context_count", "context_tables", "hot_count", "hot_tables")}
    seats = top = None
    total, sweeps = np.zeros(count.shape), 4000
    for sweep in range(sweeps):
        seats = part.reseat(seats, root, shared, sweep)
        n = part.per_word(seats.tables())
        before = np.minimum(n, 1) if top is None else top.tables()
        rest = before.sum() - before
        top = pitman_yor.seat(rng, n, lambda i, t, rest=rest: (pitman_yor.ROOT_STRENGTH + pitman_yor.ROOT_DISCOUNT * (rest[i] + t)) / (known + 1), pitman_yor.ROOT_DISCOUNT, top and pitman_yor._within(top, n))
        root = pitman_yor.Root(n, top.tables(), n.sum(), top.tables().sum(), known)
        total += part.predictive(seats.tables(), root, shared).reshape(count.shape)
    assert np.abs(total / sweeps - want).max() < 0.02


def test_a_common_pair_is_split_over_parts(spark):
    """A pair that makes up a third of all tokens is scored alike however many parts there are."""
    rng = random.Random(6)
    rows = [(i, " ".join("ha" if rng.random() < 0.6 else f"w{rng.randrange(40)}" for _ in range(30)), None, None) for i in range(200)]
    few, many = ({r.doc_id: (r.n_known, round(r.base_score, 6), r.score) for r in pitman_yor.score(table(spark, rows), part_tokens=p).collect()} for p in (10**6, 300))
    assert all(few[i][:2] == many[i][:2] and abs(few[i][2] / many[i][2] - 1) < 0.05 for i in few)


# Repeated passages


def brute_cut(rows):
    out, seen = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen.get(b[s : s + 50], i) < i:
                gone[s : s + 50] = b"\1" * 50
        for s in range(len(b) - 49):
            seen.setdefault(b[s : s + 50], i)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def cut(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_documents(df).collect()}


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(4, 40))) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = [rng.choice(shared)[rng.randrange(5) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 6))]
        rows.append((i * 3, " ".join(parts)))
    return [*rows, (500, "z" * 200), (501, "z" * 130), (502, "ab" * 60), (503, "b" + "ab" * 40), (504, rows[3][1]), (505, "\x00" * 70), (506, "\x00" * 55)]


@pytest.mark.parametrize(("seed", "run_bytes"), [(1, 10**7), (2, 700), (3, 3000)])
def test_cuts_are_exact(spark, monkeypatch, seed, run_bytes):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1000)
    rows = passages(seed)
    assert cut(table(spark, [(i, t, None, None) for i, t in rows]).repartition(5)) == brute_cut(rows)


def test_cuts_of_documents(spark):
    want = {i: (n, r, s, hashlib.sha256(k).hexdigest()) for i, (n, r, s, k) in brute_cut(documents(spark)).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()} == want


def test_cut_edges(spark, edge, empty):
    rows = suffix_dedup.cut_documents(edge).collect()
    assert len(rows) == len(EDGE) and suffix_dedup.cut_documents(empty).count() == 0
    assert {r.n_removed for r in rows if r.doc_id in (None, 7, 11)} <= {0, 340, 330} | {r.n_removed for r in rows if r.doc_id == 11}
    once = {i: t for i, t, _, _ in EDGE if i is not None}
    want = brute_cut(list(once.items()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows if r.doc_id is not None} == want
    out = suffix_dedup.remove_passages(edge)
    assert out.columns == edge.columns and out.count() == len(EDGE)
    assert {r.doc_id: r.text or "" for r in out.collect() if r.doc_id is not None} == {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in want.items()}


def test_merging_with_known_prefixes():
    rng = random.Random(4)
    for n_runs in (0, 1, 2, 5, 9):
        runs, every = [], []
        for _ in range(n_runs):
            strings = sorted(bytes(rng.choices(b"ab", k=50)) if rng.random() < 0.5 else b"a" * 40 + bytes(rng.choices(b"abc", k=10)) for _ in range(rng.randrange(0, 30)))
            shared = [0] + [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(strings, strings[1:], strict=False)]
            runs.append((strings, shared[: len(strings)]))
            every += strings
        order, prefixes = suffix_dedup.merged(runs)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(every)
        assert prefixes[1:] == [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in zip(merged, merged[1:], strict=False)]


# Packing


def unpacked(rows, texts, encode, size):
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        windows[r.sequence_id].append((r.offset, r.length))
    for i, t in texts:
        ids = np.array([*encode(t or ""), packing.END_ID], "<u4")
        at = 0
        for start, length, crc, n in sorted(pieces[i]):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= size
    return [sum(x[1] for x in w) for w in windows.values()]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(TOKENIZER)
    encode = lambda t: reader.encode(t, add_special_tokens=False).ids
    known = documents(spark)
    fills = unpacked(QUERIES["op9_packing"](spark, SF).collect(), known, encode, 2048)
    assert sum(2048 - f for f in fills) <= 0.02 * 2048 * len(fills) + 2048


def test_leftovers_of_many_partitions_are_merged(spark):
    rows = [(i, f"word{i} " * 10, None, None) for i in range(640)]
    for partitions in (1, 80):
        got = packing.pack(table(spark, rows).repartition(partitions), TOKENIZER).collect()
        tokens = sum(r.length for r in got)
        assert len({r.sequence_id for r in got}) <= tokens / 2048 * 1.1 + 3
        assert sorted((r.doc_id, r.start) for r in got if r.start == 0) == [(i, 0) for i in range(640)]


def test_packing_edges(spark, edge, empty):
    encode = packing.byte_level_encoding(TOKENIZER).encode_ordinary
    rows = [(i, t) for i, t, _, _ in EDGE if i not in (None, 11)]
    df = table(spark, [(i, t, None, None) for i, t in rows]).repartition(4)
    for size, limit in ((64, 2), (2048, 64)):
        unpacked(packing.pack(df, TOKENIZER, size=size, open_windows=limit, cut_gap=8).collect(), rows, encode, size)
    assert packing.pack(empty, TOKENIZER).count() == 0
    got = packing.pack(edge, TOKENIZER).collect()
    assert sum(r.length for r in got if r.doc_id == 11) == 2 * next(r.doc_tokens for r in got if r.doc_id == 11)
    assert sum(r.length for r in got if r.doc_id is None) == sum(len(encode(t or "")) + 1 for i, t, _, _ in EDGE if i is None)


def test_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(TOKENIZER)
    own = packing.byte_level_encoding(TOKENIZER)
    for t in ("", "Hello  world\n\n x'll 123 ñandú 😀\t", "a" * 500, "\x00\x01 é́", "  lead and trail  "):
        assert own.encode_ordinary(t) == reader.encode(t, add_special_tokens=False).ids


def test_added_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(TOKENIZER)
    encode = lambda t: reader.encode(t, add_special_tokens=False).ids
    rows = list(enumerate(["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext |> <|endoftext|", "é<|endoftext|>  y"]))
    assert 50256 in encode(rows[0][1])
    unpacked(packing.pack(table(spark, [(i, t, None, None) for i, t in rows]), TOKENIZER).collect(), rows, encode, 2048)


# The pipeline


def test_pipeline_stages(spark):
    """Each stage on what the one before kept, against brute force where there is one."""
    import corpus_pipeline
    from claimlens.llm.queries import op1_quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else None
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
            rows = out.collect()
            out = spark.createDataFrame(rows, docs.schema)
            kept = {r.doc_id: r.text for r in rows}
        if name == "quality_rules":
            assert set(kept) == {r.doc_id for r in op1_quality_rules(spark, SF).where("kept").collect()}
        if name == "near_dedup":
            assert set(kept) == {i for i, (_, c) in brute_components(list(before.items()), 5).items() if i == c}
        if name == "suffix_dedup":
            assert kept == {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in brute_cut(list(before.items())).items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "mixing":
            assert set(kept) <= set(before) and all(before[i] == t for i, t in kept.items())
            counts = collections.Counter(r.doc_id for r in rows)
            assert max(counts.values()) <= 3
        if name == "packing":
            total = sum(r.length for r in out.collect())
            encode = packing.byte_level_encoding(TOKENIZER).encode_ordinary
            assert total == sum(len(encode(r.text or "")) + 1 for r in docs.collect())
        docs = out
    assert corpus_pipeline.run(spark, SF).select(F.sum("length")).first()[0] == total


def test_pipeline_stages_on_odd_rows(spark, edge, empty):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, SF)
        assert none.count() == 0  # a stage's result is read before the next stage begins
        some = stage(spark, edge, SF)
        if name != "packing":
            assert none.columns == some.columns == edge.columns
        ids = {r.doc_id for r in some.select("doc_id").collect()}
        assert ids == {"quality_rules": {7, 8, 11}, "near_dedup": {r[0] for r in EDGE} - {5, 8}}.get(name, {r[0] for r in EDGE})


@pytest.mark.parametrize("block", [1, 7, 1 << 21])
def test_words_are_hashed_as_plain_splitting_finds_them(monkeypatch, block):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", block)
    monkeypatch.setattr(pitman_yor, "BLOCK_WORDS", max(1, block % 1000))
    rng = random.Random(block)
    texts = [None, b"", b"x" * 63 + b" " + b"X" * 64 + b" " + b"x" * 65 + b" " + b"y" * 9_000, b"Q" * 200 + b"\tq" + b"q" * 199]
    texts += [bytes(rng.choice(b"aB \n\t\x0b\x0c\r\x00\x1c\x85\xa0\xe9") for _ in range(rng.choice([0, 1, 5, 300]))) for _ in range(60)]
    hash_of, word_of = {}, {}
    got = list(pitman_yor._hashed(texts))
    assert len(got) == len(texts)
    for text, hashes in zip(texts, got, strict=True):
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text or b"")]
        assert len(hashes) == len(words) + 1 and hashes[-1] == pitman_yor.END
        for w, h in zip(words, hashes.tolist(), strict=False):
            assert hash_of.setdefault(w, h) == h and word_of.setdefault(h, w) == w
    assert list(pitman_yor._hashed([])) == []


def test_pitman_yor_tasks_keep_to_their_memory(monkeypatch):
    """A chunk of a million tokens, in texts of 30 MB that come as one batch: beyond the batch, each step stays under 90 MB."""
    monkeypatch.setattr(pitman_yor.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}".ljust(29, "x") for i in range(50_000)])
    texts = [" ".join(words[np.minimum(rng.zipf(1.3, 500) - 1, 49_999)]) for _ in range(2_000)]
    batch = pa.record_batch([pa.array(range(2_000)), pa.array(texts), pa.array([i % 10 > 0 for i in range(2_000)])], names=["doc_id", "text", "train"])
    few = pitman_yor._split([])

    def joined(rows):
        part = pa.Table.from_batches(rows)
        return pitman_yor._joined(part.filter(pa.compute.equal(part.column("part"), 0)))

    def measured(step):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        out = step()
        return out, (tracemalloc.get_traced_memory()[1] - before) / 1e6

    tracemalloc.start()
    try:
        _, heavy = measured(lambda: list(pitman_yor._heavy(0.01)(iter([batch.select(["text"])]))))
        rows, dealt = measured(lambda: list(pitman_yor._dealt(few, 1)(iter([batch]))))
        _, whole = measured(lambda: joined(rows))
    finally:
        tracemalloc.stop()
    assert max(heavy, dealt, whole) < 90, (heavy, dealt, whole)


@pytest.mark.parametrize("block", [1, 50, 1 << 21])
def test_pitman_yor_pieces_hold_every_row(monkeypatch, block):
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", block)
    texts = [None, "", "a b", "c" * 200, None, "d", "é" * 30]
    pieces = list(pitman_yor._pieces(pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"]), 1))
    assert [x for p in pieces for x in p.column(1).to_pylist()] == texts and [x for p in pieces for x in p.column(0).to_pylist()] == list(range(7))
    assert len(pieces) == {1: 7, 50: 2, 1 << 21: 1}[block]
    assert sum(p.num_rows for p in pitman_yor._pieces(pa.record_batch([pa.array([], pa.string())], names=["text"]), 0)) == 0
