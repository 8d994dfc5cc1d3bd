"""Documents to training sequences: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. `run` does the same with tables in the shared folder.

Defined cases, as the operators state them: null, empty and short texts fail the
base rules; the deduplications keep rows without id but for the copied bytes in
them; repeated rows are kept or dropped together; an empty table passes every
stage as an empty one; other columns are carried along up to the last stage.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimlens.llm import mixing, near_duplicates, packing, quality_rules, suffix_dedup
from claimlens.llm.tables import drop_staged, read, stage_table, staged_so_far

class _Before(threading.local):
    """The tables that this thread's stage before staged: its result is written by the time that the next one begins."""

    def __init__(self):
        self.marks: list[tuple[int, int]] = []


_before = _Before()


def _staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before.marks:
            drop_staged(spark, *_before.marks.pop())
        start = staged_so_far()
        try:
            return stage(spark, docs, sf_dir)
        finally:  # a stage that fails leaves what it staged to the next one too
            _before.marks.append((start, staged_so_far()))

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep."""
    return quality_rules.reject(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_duplicates.drop_near_copies(docs, width=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has."""
    return suffix_dedup.remove_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeated as often as their sources' targets ask."""
    return mixing.apply_mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _staged(quality)),
    ("near_dedup", _staged(near_copies)),
    ("suffix_dedup", _staged(passages)),
    ("mixing", _staged(mixture)),
    ("packing", _staged(sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held: list[tuple[int, int]] = []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            start = staged_so_far()
            docs = stage_table(docs, f"stage-{name}")
            held.append((start, staged_so_far()))
            if len(held) > 1:
                drop_staged(spark, *held.pop(0))
    return docs


#: Learned rules, MinHash confirmation over components and suffix runs are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
