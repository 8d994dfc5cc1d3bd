"""Language identification by interpolated Kneser-Ney character models.

Each language gets one model over the characters of its words, a word being
read between two blanks. N-grams are keyed by 64-bit hashes in sorted arrays,
with a column of log probabilities for each of a few languages that share the array,
so that all models grow in proportion to their n-grams; a text goes to the
language of least cross-entropy per character. The margin over the second best
is turned into a score by isotonic calibration on texts that the models did not
see, and a text whose cross-entropy is above what such texts of its language
reach is marked as not accepted.

The models learn from a sample of SAMPLE_CHARS characters a language: pieces of
PIECE_CHARS, taken in the order of a hash of id and place until the next would be
too much. The first piece with a letter is always taken and learned from. Beyond
FULL_SAMPLES languages all share what that many would have, so that the size of
what is learned from stays bounded but for these first pieces; the models' bytes
are checked before they are sent to workers. Every text is judged whole, each
distinct word of a batch once.

Defined cases: a null text or one without a letter is `und` with score 0; with
no language learned, all texts are `und`; rows whose lang is null are not
learned from; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.calibration import isotonic
from claimlens.llm.tables import remainder, stage_table

ORDER = 4
DISCOUNT = 0.75
SAMPLE_CHARS = 2_000_000
#: Texts are sampled in pieces of so many characters.
PIECE_CHARS = 20_000
#: Bits of the hash that one histogram of pieces resolves.
STEP_BITS = 8
#: Languages whose n-grams share a table.
BLOCK = 8
#: Models that are sent to all workers take at most so many bytes.
MOST_BYTES = 2 << 30
#: Languages that get a whole sample each; of more, all share as many characters.
FULL_SAMPLES = 256
HOLDOUT = 5
#: Share of calibration texts of a language that stay accepted.
ACCEPTED = 0.995
BINS = 200
#: Characters of a batch that are scored together.
CHUNK_CHARS = 8_000_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _has_letter(text: str, words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(map(str.isalpha, text))


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words, each with a blank before and after, as code points; and where each word's blank stands."""
    joined = " " + "  ".join(words) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n code points that end at each place; the first n - 1 places are not whole."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(n - 1, -1, -1):
        shifted = np.concatenate([np.zeros(k, np.uint64), codes[: len(codes) - k]])
        h = (h ^ (shifted + np.uint64(n))) * _MIX
        h ^= h >> np.uint64(29)
    return h


@dataclass(frozen=True)
class Block:
    """Models of a few languages, so that a table of all their n-grams is as long as their own ones are many."""

    #: For each order: sorted hashes, log probabilities and log back-off weights (a column for each language, 0 where unseen).
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (*self.keys, *self.logp, *self.back))

    def words(self, codes: np.ndarray, starts: np.ndarray, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log probability of each word in each language of the block."""
        n = len(codes)
        best = np.tile(self.floor, (n, 1)).astype(np.float32)
        before = np.full(n, -1)
        for order in range(1, ORDER + 1):
            keys = self.keys[order - 1]
            at = np.full(n, -1)
            whole, h = hashes[order - 1]
            i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[i] == h if len(keys) else np.zeros(len(h), bool)
            at[whole[hit]] = i[hit]
            if order > 1:
                context = np.concatenate([[-1], before[:-1]])
                used = whole[context[whole] >= 0]
                best[used] += self.back[order - 2][context[used]]
            seen = np.flatnonzero(at >= 0)
            p = self.logp[order - 1][at[seen]]
            best[seen] = np.where(p < 0, p, best[seen])
            before = at
        best[starts] = 0.0
        return np.add.reduceat(best, starts, axis=0).astype(np.float64)


@dataclass(frozen=True)
class Models:
    languages: list[str]
    #: In order of the languages, BLOCK of them in each.
    blocks: list[Block]
    limits: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    @property
    def nbytes(self) -> int:
        """At most 8 + 8 * BLOCK bytes for each n-gram of each language."""
        return sum(b.nbytes for b in self.blocks)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, its characters, and whether it has a letter."""
        ids: dict[str, int] = {}
        docs, places, letters = [], [], np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            letters[i] = bool(text) and _has_letter(text, words)
            places.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)))
            docs.append(np.full(len(words), i))
        if not ids:
            return np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), letters
        codes, starts = _code_points(list(ids))
        chars = np.diff(np.append(starts, len(codes))) - 1
        since = np.arange(len(codes)) - np.repeat(starts, chars + 1)
        hashes = []
        for order in range(1, ORDER + 1):
            whole = np.flatnonzero(since >= order - 1)
            hashes.append((whole, _hashes(codes, order)[whole]))
        doc, place = np.concatenate(docs).astype(np.int64), np.concatenate(places)
        length = np.bincount(doc, chars[place], len(texts))
        total = []
        for block in self.blocks:  # one block's scores of words at a time
            logp = block.words(codes, starts, hashes)
            total += [np.bincount(doc, logp[place, j], len(texts)) for j in range(logp.shape[1])]
        return -np.stack(total, axis=1) / np.maximum(length, 1)[:, None], length, letters

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its cross-entropy, the margin over the next scaled by length, and whether there is a letter."""
        h, length, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        rest = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else h[:, 0] + 1.0
        low = h[np.arange(len(h)), best]
        return best, low, np.minimum((rest - low) * np.sqrt(length), 50.0), letters


def _train(words: dict[str, int]) -> tuple[list[dict], float]:
    """For each order, hash -> (log probability, log back-off weight); and the log probability of an unseen character."""
    grams: list[dict[str, float]] = [defaultdict(float) for _ in range(ORDER)]
    for word, n in words.items():
        padded = f" {word} "
        for i in range(1, len(padded)):
            grams[ORDER - 1][padded[max(0, i - ORDER + 1) : i + 1]] += n
    # Lower orders count the distinct characters before a gram; what starts a word keeps its own count of types.
    whole = dict(grams[ORDER - 1])
    top: dict[str, float] = {g: n for g, n in whole.items() if len(g) == ORDER}
    levels: list[dict[str, float]] = [{} for _ in range(ORDER)]
    levels[ORDER - 1] = top
    for order in range(ORDER - 1, 0, -1):
        level: dict[str, float] = defaultdict(float)
        for g, n in whole.items():
            if len(g) == order and order > 1:
                level[g] += n
        for g in levels[order]:
            level[g[1:]] += 1
        levels[order - 1] = dict(level)
    size = len(levels[0]) + 1
    out: list[dict] = []
    probability: dict[str, float] = {}
    for order in range(1, ORDER + 1):
        total: dict[str, float] = defaultdict(float)
        kinds: dict[str, int] = defaultdict(int)
        for g, n in levels[order - 1].items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        found = {}
        for g, n in levels[order - 1].items():
            c = g[:-1]
            lower = probability.get(g[1:], 1.0 / size) if order > 1 else 1.0 / size
            found[g] = max(n - DISCOUNT, 0.0) / total[c] + DISCOUNT * kinds[c] / total[c] * lower
        weights = {c: DISCOUNT * kinds[c] / total[c] for c in total}
        probability = found
        out.append({"p": found, "w": weights})
    base = out[0]["w"].get("", 1.0) / size
    return out, float(np.log(base))


def _learned(key: tuple, table: pa.Table) -> pa.Table:
    """The model of one language as one row for each order; its words are those of the bounded sample."""
    words = dict(zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True))
    orders, floor = _train(words)
    rows = []
    for order in range(1, ORDER + 1):
        grams = set(orders[order - 1]["p"]) | (set(orders[order]["w"]) if order < ORDER else set())
        found = sorted(grams)
        codes = np.array([[ord(c) for c in g] for g in found], np.uint64).reshape(len(found), order)
        h = np.zeros(len(found), np.uint64)
        for k in range(order):
            h = (h ^ (codes[:, k] + np.uint64(order))) * _MIX
            h ^= h >> np.uint64(29)
        p = np.array([np.log(orders[order - 1]["p"][g]) if g in orders[order - 1]["p"] else 0.0 for g in found], np.float32)
        w = np.array([np.log(orders[order]["w"][g]) if order < ORDER and g in orders[order]["w"] else 0.0 for g in found], np.float32)
        rows.append((key[0].as_py(), order, floor, h.tobytes(), p.tobytes(), w.tobytes()))
    return pa.table(list(map(pa.array, zip(*rows, strict=True))), schema=pa.schema([("lang", pa.string()), ("ord", pa.int32()), ("floor", pa.float64()), ("h", pa.binary()), ("p", pa.binary()), ("w", pa.binary())]))


def _assembled(rows: list) -> Models | None:
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    blocks = [_block(languages[i : i + BLOCK], rows) for i in range(0, len(languages), BLOCK)]
    return Models(languages, blocks, np.full(len(languages), np.inf), np.array([0.0]), np.array([0.5]))


def _block(languages: list[str], rows: list) -> Block:
    at = {x: i for i, x in enumerate(languages)}
    rows = [r for r in rows if r["lang"] in at]
    keys, logp, back = [], [], []
    for order in range(1, ORDER + 1):
        own = [(at[r["lang"]], *[np.frombuffer(r[c], t) for c, t in (("h", np.uint64), ("p", np.float32), ("w", np.float32))]) for r in rows if r["ord"] == order]
        k = np.unique(np.concatenate([h for _, h, _, _ in own]))
        p, w = np.zeros((len(k), len(languages)), np.float32), np.zeros((len(k), len(languages)), np.float32)
        for j, h, lp, lw in own:
            i = np.searchsorted(k, h)
            p[i, j], w[i, j] = lp, lw
        keys.append(k), logp.append(p), back.append(w)
    floor = np.zeros(len(languages))
    for r in rows:
        floor[at[r["lang"]]] = r["floor"]
    return Block(keys, logp, back, floor)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[tuple[str, str], int] = defaultdict(int)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w in words_of(text):
                count[lang, w] += 1
        langs, words = zip(*count, strict=True) if count else ((), ())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(count.values(), pa.int64())], names=["lang", "word", "n"])


def _limits(pieces: DataFrame, langs: list[str], sample_chars: int) -> dict[str, int]:
    """For each language the last hash up to which its pieces (lang, h, chars) make up at most sample_chars.

    Histograms of buckets of the hash are nested: each looks into the one bucket
    of a language in which the sample ends, till it holds one piece.
    """
    limits = {lang: (1 << 63) - 1 for lang in langs}
    taken: dict[str, int] = dict.fromkeys(langs, 0)
    inside: dict[str, int | None] = dict.fromkeys(langs)
    for bits in range(64 - STEP_BITS, -1, -STEP_BITS):
        rows = pieces.select("lang", "chars", "h")
        if bits < 64 - STEP_BITS:
            open_still = pieces.sparkSession.createDataFrame(list(inside.items()), "lang string, bucket long")
            rows = rows.join(F.broadcast(open_still), "lang").where(F.shiftright("h", bits + STEP_BITS) == F.col("bucket"))
        buckets = rows.groupBy("lang", F.shiftright("h", bits).alias("b")).agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
        inside = {}
        last = None
        for r in sorted(buckets.collect(), key=lambda r: (r["lang"], r["b"])):
            if r["lang"] == last:
                continue
            if taken[r["lang"]] + r["chars"] <= sample_chars:
                taken[r["lang"]] += r["chars"]
                continue
            last = r["lang"]
            limits[last] = (r["b"] << bits) - 1
            if r["n"] > 1:
                inside[last] = r["b"]
        if not inside:
            break
    return limits


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", holdout: int = HOLDOUT, sample_chars: int = SAMPLE_CHARS) -> Models | None:
    """Models of all languages from the rows outside the held-out fold."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder("doc_id", holdout) != 0))
    # Where the first letter stands decides which piece can be learned from.
    letter = F.when(F.col("text").rlike(r"\p{L}"), F.floor(F.char_length(F.regexp_extract("text", r"(?s)^(\P{L}*+)\p{L}", 1)) / PIECE_CHARS))
    place = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / PIECE_CHARS).cast("int") - 1, F.lit(0)))).alias("place")
    pieces = known.select("lang", "doc_id", F.char_length("text").alias("length"), letter.alias("letter"), place)
    size = F.least(F.col("length") - F.col("place") * PIECE_CHARS, F.lit(PIECE_CHARS)).cast("long")
    pieces = stage_table(pieces.select("lang", "doc_id", "place", (F.col("place") == F.col("letter")).alias("letter"), size.alias("chars"), F.xxhash64(F.lit("sample"), "doc_id", "place").alias("h")), "language-pieces")
    firsts = pieces.groupBy("lang").agg(F.min(F.when(F.col("letter"), F.struct("h", "doc_id", "place"))).alias("first")).collect()
    if not firsts:
        return None
    sample_chars = min(sample_chars, max(1, sample_chars * FULL_SAMPLES // len(firsts)))
    limits = _limits(pieces, [r["lang"] for r in firsts], sample_chars)
    rows = [(r["lang"], limits[r["lang"]], *(r["first"][c] if r["first"] else None for c in ("doc_id", "place"))) for r in firsts]
    taking = docs.sparkSession.createDataFrame(rows, f"lang string, limit long, first_id {known.schema['doc_id'].dataType.simpleString()}, first_place int")
    first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    taken = (F.col("h") <= F.col("limit")) | (first & F.col("place").eqNullSafe(F.col("first_place")))
    # The hash is read again from the texts, so that only pieces taken are cut out.
    cut = known.select("*", place).withColumn("h", F.xxhash64(F.lit("sample"), "doc_id", "place")).join(F.broadcast(taking), "lang").where(taken)
    tune = ~first & (F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(4)) == 0)
    sample = cut.select("doc_id", F.substring("text", F.col("place") * PIECE_CHARS + 1, F.lit(PIECE_CHARS)).alias("text"), "lang", tune.alias("tune"))
    sample = stage_table(sample, "language-sample")
    counts = sample.where("not tune").select("lang", "text").mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").applyInArrow(_learned, "lang string, ord int, floor double, h binary, p binary, w binary").collect()  # bounded by the sample
    models = _assembled(rows)
    if models is None:
        return None
    if models.nbytes > MOST_BYTES:
        raise ValueError(f"the models of {len(models.languages)} languages take {models.nbytes} bytes; give a smaller sample_chars")

    def tuned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, low, margin, letters = models.margins(batch.column("text").to_pylist())
            found = [models.languages[b] for b in best]
            yield pa.record_batch([pa.array(x) for x in (found, low, margin, letters)] + [batch.column("lang")], names=["found", "low", "margin", "letters", "lang"])

    seen = stage_table(sample.where("tune").select("lang", "text").mapInArrow(tuned, "found string, low double, margin double, letters boolean, lang string").where("letters"), "language-tuning")
    right = (F.col("found") == F.col("lang")).cast("int")
    bins = seen.groupBy(F.floor(F.least("margin", F.lit(49.9)) * BINS / 50).alias("b")).agg(F.avg("margin"), F.sum(right), F.count("*")).collect()
    knots, rates = isotonic(*[np.array([b[i] for b in bins], float) for i in (1, 2, 3)])
    limits = models.limits.copy()
    for r in seen.where(right == 1).groupBy("lang").agg(F.percentile_approx("low", ACCEPTED, 10_000).alias("q")).collect():
        limits[models.languages.index(r["lang"])] = r["q"]
    return Models(models.languages, models.blocks, limits, knots, rates)


def identify(docs: DataFrame, models: Models | None, *, id_col: str = "doc_id", text_col: str = "text", holdout: int = HOLDOUT) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and whether the text is close enough to what its language's texts look like."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, all_texts, start = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while start < len(ids):
                end, chars = start, 0
                while end < len(ids) and (end == start or chars < CHUNK_CHARS):
                    chars, end = chars + len(all_texts[end] or ""), end + 1
                texts = all_texts[start:end]
                if own is None:
                    pred, score, ok = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                else:
                    best, low, margin, letters = own.margins(texts)
                    pred = [own.languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)]
                    score = np.where(letters, np.clip(np.interp(margin, own.knots, own.rates), 0.0, 1.0), 0.0)
                    ok = letters & (low <= own.limits[best])
                yield pa.record_batch([pa.array(ids[start:end], pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])
                start = end

    out = texts.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", (remainder("doc_id", holdout) == 0).alias("held_out"), "lang_pred", "score", "accepted")
