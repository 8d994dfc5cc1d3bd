"""Mixing sources to target weights by hash-threshold histograms.

Targets: sources in code-point order (null last) weigh by a repeating cycle and
share all words; a target stops at a multiple of its source's size and the
excess is shared again by weight among the rest. A source is taken as many
whole times as its target holds, and once more for the documents whose hash
lies under a threshold. The threshold comes from nested histograms: words are
summed by source and leading hash bits, only the bucket that the budget ends in
is split by further bits, and the documents are filtered, never sorted.

Defined cases: a null source is a source of its own; a null or empty text has
size 0 and is taken with 0 words; repeated rows share their hash, so are taken
together; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.tables import WORD, stage_table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3.0
#: Bits of the hash, and bits by which each histogram splits a bucket.
HASH_BITS = 32
LEVELS = (11, 11, 10)
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash32(doc_id: Column) -> Column:
    """The first 32 bits of md5 of the id as text: the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """(source_key, source_size, target) from rows (source_key, size).

    Only sums over all sources reach the driver, one pair for each round of
    resharing; the rows of sources stay in Spark.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("source_key.missing", "source_key.name")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = stage_table(per.select("*", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(float(most_times))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        capped = F.lit(False) if level is None else (F.col("weight") * F.lit(level) > cap)
        free, held, n = per.agg(
            F.sum(F.when(~capped, F.col("weight"))),
            F.sum(F.when(capped, cap)),
            F.count(F.when(capped, 1)),
        ).first()
        new = (total - (held or 0.0)) / free if free else (level or 0.0)
        if level is not None and (not free or n == before):
            break
        level, before = new, n
    return per.select("source_key", "source_size", F.when(F.col("weight") * F.lit(level) > cap, cap).otherwise(F.col("weight") * F.lit(level)).cast("double").alias("target"))


def _thresholds(sizes: DataFrame, targets: DataFrame, small: bool) -> DataFrame:
    """(source_key, times, threshold): documents with hash up to the threshold are taken once more than `times`."""
    side = F.broadcast if small else (lambda x: x)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = targets.select("source_key", times.alias("times"), (F.col("target") - times * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    shift = HASH_BITS
    for level, bits in enumerate(LEVELS):
        lead, shift = shift, shift - bits
        inside = sizes.join(side(goal), "source_key").where(F.shiftright("hash", lead) == F.col("prefix"))
        sums = inside.groupBy("source_key", "times", "rest", "below", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.col("below") + F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket"))
        seen = sums.withColumn("upto", run).withColumn("before", F.col("upto") - F.col("words"))
        # The first bucket that passes the budget; the last one if none does.
        split = seen.groupBy("source_key", "times", "rest").agg(
            F.min_by(F.struct("bucket", "before", "upto"), F.struct(F.when(F.col("upto") > F.col("rest"), 0).otherwise(1), F.when(F.col("upto") > F.col("rest"), F.col("bucket")).otherwise(-F.col("bucket")))).alias("b")
        )
        goal = stage_table(split.select("source_key", "times", "rest", F.col("b.bucket").alias("prefix"), F.col("b.before").cast("double").alias("below"), F.col("b.upto").cast("double").alias("upto")), f"mix-level{level}")
        last, goal = goal, goal.drop("upto")
    near = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("below"))
    return last.select("source_key", "times", F.when((F.col("upto") <= F.col("rest")) | near, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))


def _key(source: Column) -> Column:
    return F.struct(source.isNull().alias("missing"), F.coalesce(source.cast("string"), F.lit("")).alias("name"))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], most_times: float) -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows, and for each source its target, whole times and threshold (broadcast if they are few)."""
    sizes = stage_table(docs.select(F.col(id_col).alias("doc_id"), _key(F.col(source_col)).alias("source_key"), word_count(F.col(text_col)).alias("size"), hash32(F.col(id_col)).alias("hash")), "sizes")
    targets = stage_table(source_targets(sizes, weights, most_times), "targets")
    small = targets.count() <= BROADCAST_SOURCES
    limits = stage_table(_thresholds(sizes, targets, small).join(targets, "source_key"), "limits")
    return sizes, F.broadcast(limits) if small else limits


def _times(most_times: float, digest: Column) -> Column:
    return F.least(F.col("times") + (digest <= F.col("threshold")).cast("long"), F.lit(int(most_times)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """doc_id, size, source_size, target and the number of times that the mix takes each document."""
    sizes, limits = _planned(docs, id_col, text_col, source_col, weights, most_times)
    times = _times(most_times, F.col("hash"))
    return sizes.join(limits, "source_key").select("doc_id", "source_key", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """The documents of the mix, each row as many times as it is taken, with their own columns.

    What a row is taken follows from its source and the hash of its id, so texts stay where they are.
    """
    _, limits = _planned(docs, id_col, text_col, source_col, weights, most_times)
    side = limits.select(F.col("source_key").alias("__mix_key"), "times", "threshold")
    times = _times(most_times, F.col("__mix_hash"))
    own = [F.col(c).alias(f"__own_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, _key(F.col(source_col)).alias("__key"), hash32(F.col(id_col)).alias("__mix_hash"))
    copies = rows.join(side, F.col("__key") == F.col("__mix_key")).withColumn("__times", times).where("__times > 0")
    copies = copies.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return copies.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
