"""Quality classifier: ridge scores over random Fourier features, calibrated by isotonic regression.

Each text becomes a short vector of statistics. Cosines of random projections
approximate a Gaussian kernel on them; the normal equations of a ridge fit are
summed in each partition, then added up row by row of the matrix, so the driver
solves one system of FEATURES + 1 unknowns. A part of the labelled rows that
the fit does not see calibrates the scores, from counts in BINS bins.

At most MAX_LABELLED labelled rows are learned from, chosen by a hash of the
id; every text is scored.

Defined cases: a null text scores as an empty one; without usable labels all
scores are 0.5; rows with a null label are not learned from; repeated rows score
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.calibration import isotonic
from claimlens.llm.tables import remainder, stage_table

FEATURES = 512
GAMMA = 0.05
RIDGE = 0.1
#: Standard scores are bent by tanh to stay within this, so that no text lies far from all others.
REACH = 2.0
BINS = 1000
MAX_LABELLED = 1_000_000
#: Partitions that the labelled rows are summed in.
SUM_PARTITIONS = 64
HOLDOUT = 5
THRESHOLD = 0.3
SEED = 20_240_501
STATS = 15


def _statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    mark = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    symbol = sum(seen[c] for c in b"#*$%&|<>")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = sum(map(operator.eq, words, words[1:]))
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        min(20.0, (size - seen[32]) / n),
        upper / max(1, upper + lower),
        digit / size,
        min(1.0, mark / n / 4),
        min(2.0, symbol / n),
        min(2.0, seen[33] / n),
        len(set(words)) / n,
        repeats / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        seen[128:].sum() / size,
        min(1.0, (seen[44] + seen[46]) / n),
        float(not words),
    ]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_statistics(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    rates: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0.0, np.sqrt(2 * GAMMA), (STATS, FEATURES))
        b = rng.uniform(0.0, 2 * np.pi, FEATURES)
        z = np.cos(np.tanh((x - self.mean) / self.scale / REACH) * REACH @ w + b) * np.sqrt(2.0 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # A small share of the raw score keeps the order of texts inside a flat part.
        return np.clip(0.99 * np.interp(raw, self.knots, self.rates) + 0.01 * (raw + 0.5) / 2, 0.0, 1.0)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(-1, STATS)


def _sums(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch))
                total += z.T @ np.hstack([z, np.asarray(batch.column("y"), float)[:, None]])
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    sums = np.asarray(table.column("sums").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"row": table.column("row").slice(0, 1).cast(pa.int32()), "sums": pa.array([sums], pa.list_(pa.float64()))})


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_vectors, "doc_id long, x array<double>")


def fit(x: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from vectors (doc_id, x) and labels (doc_id, 0 or 1), without the held-out fold."""
    y = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
    rows = x.join(y, "doc_id").where(remainder("doc_id", HOLDOUT) != 0)
    n = y.count()
    if n > max_labelled:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    rows = stage_table(rows.withColumn("tune", F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(4)) == 0), "labelled")
    fitted, tuned = rows.where("not tune"), rows.where("tune")
    moments = fitted.agg(F.count("*"), *[f(F.col("x")[i]) for i in range(STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    mean, spread = np.array(moments[1::2], float), np.array(moments[2::2], float)
    model = Model(mean, np.maximum(spread, 0.05), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    parts = fitted.select("x", "y").coalesce(SUM_PARTITIONS).mapInArrow(_sums(model), "row int, sums array<double>")
    got = parts.groupBy("row").applyInArrow(_added, "row int, sums array<double>").collect()
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in got:  # FEATURES + 1 rows
        system[r["row"]] = r["sums"]
    weights = np.linalg.solve(system[:, :-1] + RIDGE * np.eye(FEATURES + 1), system[:, -1])
    model = Model(model.mean, model.scale, weights, model.knots, model.rates)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(_matrix(batch))
                yield pa.record_batch([pa.array(np.minimum(BINS - 1, (raw + 0.5) / 2 * BINS).astype(np.int32)), pa.array(raw), batch.column("y")], names=["bin", "raw", "y"])

    bins = tuned.select("x", "y").mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw"), F.sum("y"), F.count("*")).collect()
    columns = [np.array([b[i] for b in bins], float) for i in (1, 2, 3)]
    knots, rates = isotonic(*columns)
    return Model(model.mean, model.scale, weights, knots, rates)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every text."""
    x = stage_table(vectors(docs, id_col, text_col), "vectors")
    model = fit(x, labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch)) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.record_batch([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = x.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", (remainder("doc_id", HOLDOUT) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
