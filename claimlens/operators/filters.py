"""Unclaimed names by a Bloom filter of the registry's answers, so that most names are settled without a shuffle.

The filter is an array of 64-bit words; a name sets BITS bits of the one word that
its hash names. Words are made by partial `bit_or` aggregation and merged; there
are at most MOST_WORDS of them, whatever the registry's size, so the filter may be
broadcast (a larger registry fills it more, and more names go on to the exact
join). A name of which a bit is not set has no other answer than 404: that is
exact. The rest, names with answers and a few percent more, are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.registry import answered_otherwise, unclaimed
from claimlens.session import stage

BITS = 4
#: Words for each 8 names; a filter of 2^20 words is 16 MB as rows.
NAMES_A_WORD = 8
MOST_WORDS = 1 << 20


def _word(name: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(words))


def _mask(name: Column) -> Column:
    """BITS bits of a word, from six bits each of a second hash."""
    h = F.xxhash64(F.lit("bits"), name)
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)])


def bloom_filter(names: DataFrame, column: str = "package") -> tuple[DataFrame, int]:
    """(word, bits) of the words that are not empty, staged, and how many words there are."""
    n = names.count()
    words = min(MOST_WORDS, max(1, 1 << (n // NAMES_A_WORD).bit_length()))
    own = names.select(_word(F.col(column), words).alias("word"), _mask(F.col(column)).alias("mask"))
    return stage(own.groupBy("word").agg(F.bit_or("mask").alias("bits")), "bloom"), words


def maybe_in(rows: DataFrame, bloom: tuple[DataFrame, int], column: str = "package") -> DataFrame:
    """rows with `maybe`: false only if the filter's names do not hold the row's."""
    words, n = bloom
    known = words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    mask = _mask(F.col(column))
    found = rows.join(F.broadcast(known), _word(F.col(column), n) == F.col("__word"), "left")
    return found.select(*rows.columns, F.coalesce(F.col("__bits").bitwiseAND(mask) == mask, F.lit(False)).alias("maybe"))


def unclaimed_by_filter(firsts: DataFrame, log: DataFrame) -> DataFrame:
    """What registry.unclaimed gives."""
    others = answered_otherwise(log)
    marked = maybe_in(firsts, bloom_filter(others))
    settled = marked.where(~F.col("maybe")).select(F.col("package").alias("unclaimed_package"), "source_url")
    return settled.unionByName(unclaimed(marked.where("maybe").drop("maybe"), log))
