"""Resampling of documents by their importance towards a target distribution of hashed word features.

Features are runs of one or two words, filed in buckets by the CRC-32 of their
bytes. Bucket counts of all documents and of all target texts give each bucket's
gain, the log ratio of its smoothed shares; a document's weight is its features'
mean gain, and random Gumbel noise, fixed by its id, makes the highest scores a
draw without replacement in proportion to the weights.

Texts are read as Arrow buffers: a lookup table classifies and lower-cases the
bytes, differences give the words' bounds, and one table-driven CRC step moves on
all words that are long enough at once, then all pairs from their first word's
state. Counts are summed within tasks before the shuffle. Scores are integers of
a bounded range (both logarithms are), so that their histogram gives the last
score that is drawn; only rows from there on are ordered, by ranges of (score,
id), and numbered from the ranges' sizes. Two passes over the texts, no window
over a table.

Defined cases: a null, empty or wordless text has no features and weight 0, and
as it has less than `least_words` it is never drawn; a text of any length is taken
whole; a null id counts as an empty one for its noise and ranks before others of
its score; repeated rows are scored alike and each has a rank of its own; an
empty table gives an empty result, an empty target equal counts of 0; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.bytewords import Words, sliced, words
from claimlens.llm.tables import stage_table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Longer words' CRCs are taken one by one.
STEPS = 48


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()
_ALL = np.uint32(0xFFFFFFFF)


def _stepped(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def advance(state: np.ndarray, found: Words, which: np.ndarray) -> np.ndarray:
    """CRC register states after the bytes of the words `which`, all moved on together."""
    order = np.argsort(-found.lengths[which], kind="stable")
    lengths, starts, out = found.lengths[which][order], found.starts[which][order], state[order]
    # How many words are longer than k bytes.
    longer = np.searchsorted(-lengths, -np.arange(min(STEPS, int(lengths[0]) if len(lengths) else 0)), "left")
    for k, n in enumerate(longer):
        out[:n] = _stepped(out[:n], found.data[starts[:n] + k].astype(np.uint32))
    for i in range(int(np.searchsorted(-lengths, -STEPS, "left"))):
        rest = found.data[starts[i] + STEPS : starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i] ^ _ALL)) ^ int(_ALL)
    back = np.empty_like(out)
    back[order] = out
    return back


def features(found: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of one or two words, and the texts that they stand in."""
    every = np.arange(len(found.starts))
    one = advance(np.full(len(every), _ALL), found, every)
    first = np.flatnonzero(found.text[1:] == found.text[:-1])
    two = advance(_stepped(one[first], np.full(len(first), 32, np.uint32)), found, first + 1)
    return np.concatenate([one, two] if len(first) else [one]).__xor__(_ALL) % np.uint32(buckets), np.concatenate([found.text, found.text[first]])


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in sliced(batch, 0):
                total += np.bincount(features(words(piece.column(0)), buckets)[0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; only as many numbers as buckets reach the driver."""
    out = np.zeros(buckets, np.int64)
    for r in texts.select(F.col(text_col).cast("string")).mapInArrow(_counts(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the target's smoothed share of each bucket to all texts', rounded down."""
    k, s_all, t_all = len(all_counts), float(all_counts.sum()), float(target_counts.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(all_counts.tolist(), target_counts.tolist(), strict=True)], np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, 1):
                found = words(piece.column(1))
                bucket, text = features(found, len(gain))
                n = np.bincount(text, minlength=found.n_texts)
                # Whole numbers far below 2^53, so their sums as doubles are exact.
                total = np.bincount(text, weights=gain[bucket], minlength=found.n_texts).astype(np.int64)
                n_words = np.bincount(found.text, minlength=found.n_texts)
                yield pa.record_batch([piece.column(0), pa.array(n, pa.int64()), pa.array(n_words, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], names=["doc_id", "n_features", "n_words", "weight"])

    return run


def weighted(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words and weight for every row."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_weights(gain), "doc_id long, n_features long, n_words long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED):
    """A thousand times a Gumbel variate, rounded down, that the id fixes."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """rows with rank, their place in the order from 1: sorted in ranges, which are shifted by the sizes of those before."""
    mark = F.monotonically_increasing_id()
    placed = stage_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", mark), "ranges")
    part = F.shiftright("__at", 33)
    shifts, before = [], 0
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        shifts.append((r["part"], before))
        before += r["n"]
    shift = rows.sparkSession.createDataFrame(shifts, "__part long, __before long")
    rank = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(shift), "__part").select(*rows.columns, rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **columns) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; rank is null for rows that are not drawn."""
    scored = weighted(docs, target, **columns)
    scored = stage_table(scored.withColumn("score", F.col("weight") + noise(seed=seed)), "importance")
    able = F.col("n_words") >= least_words
    sizes = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()  # scores have a bounded range
    quota = percent * sum(r["n"] for r in sizes) // 100
    last, above = None, 0
    for r in sorted(sizes, key=lambda r: -r["score"]):
        if above >= quota:
            break
        last, above = r["score"], above + r["n"]
    columns_out = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*columns_out, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= last)
    drawn = numbered(scored.where(high).select(*columns_out), F.col("score").desc(), F.col("doc_id").asc())
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return drawn.unionByName(scored.where(~high).select(*columns_out, F.lit(None).cast("long").alias("rank")))
