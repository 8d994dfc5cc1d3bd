"""Findings while references and registry answers still come in, and the first source of each package so far.

References and answers are two streams. A left outer join holds each reference
until the watermark says that no answer within `wait` of it can come any more; it
then passes if no answer but 404 has met it, as in batch: a name that nobody
answers for counts as 404, and repeated answers change nothing. `answered` is the
stricter form, in which an answer has to say so.

The first source of a package is the least (file, place) of all references so far.
Each task first reduces its rows of a batch, so that a popular package sends one
row a task; keyed state then holds the least one and puts out a row when a package
is new or when a smaller one corrects what was put out before.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimlens.operators.references import references
from claimlens.operators.registry import outcome

WAIT = "1 hour"
DELAY = "10 minutes"


def _answers(answers: DataFrame, time: str, delay: str) -> DataFrame:
    """(answer, answered_at, said) with a watermark."""
    error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    rows = answers.select(F.col("package").alias("answer"), F.col(time).alias("answered_at"), outcome(F.col("status"), error).alias("said"))
    return rows.withWatermark("answered_at", delay)


def unclaimed_references(refs: DataFrame, answers: DataFrame, *, time: str = "ts", wait: str = WAIT, delay: str = DELAY, answered: bool = False) -> DataFrame:
    """The references (package, time, ...) for which no other answer than 404 came within `wait` of them; tables too.

    As streams, refs come with a watermark. With answered, only references for
    which an answer said 404, once for each such answer; they wait for the others
    all the same.
    """
    said = _answers(answers, time, delay)
    near = f"answer = package AND answered_at >= {time} - INTERVAL {wait} AND answered_at <= {time} + INTERVAL {wait}"
    if answered:
        refs = refs.join(said.where("said = 'unclaimed'").select("answer", "answered_at"), F.expr(near), "inner").drop("answer", "answered_at")
    others = said.where("said <> 'unclaimed'").select("answer", "answered_at")
    return refs.join(others, F.expr(near), "left_outer").where("answer IS NULL").drop("answer", "answered_at")


def findings(files: DataFrame, answers: DataFrame, mode: str = "regex", *, time: str = "ts", wait: str = WAIT, delay: str = DELAY, answered: bool = False) -> DataFrame:
    """(package, page_id, pos, source_url) of each unclaimed reference, from streams of files (page_id, url, body, time) and answers.

    The watermark stands on the files, so that one without references moves it on too.
    """
    refs = references(files.withWatermark(time, delay), mode, outer=True).select("package", "page_id", "pos", F.col("url").alias("source_url"), time)
    return unclaimed_references(refs, answers, time=time, wait=wait, delay=delay, answered=answered).drop(time)


#: Columns of a source: the package, its place in order, and where it is.
SOURCE = "package string, page_id long, pos long, source_url string"
_OUT = f"{SOURCE}, corrects boolean"


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least row of each package in each batch."""
    for batch in batches:
        rows = batch.to_pandas().sort_values(["package", "page_id", "pos"]).drop_duplicates("package")
        yield pa.RecordBatch.from_pandas(rows, schema=batch.schema, preserve_index=False)


class FirstSource(StatefulProcessor):
    """Holds the least (page_id, pos) of a package and its url."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.least = handle.getValueState("least", "page_id long, pos long, source_url string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.least.get() if self.least.exists() else None
        best = held
        for part in rows:
            for row in part[["page_id", "pos", "source_url"]].itertuples(index=False, name=None):
                if best is None or row[:2] < tuple(best)[:2]:
                    best = (int(row[0]), int(row[1]), row[2])
        if best is not held:
            self.least.update(best)
            yield pd.DataFrame([(key[0], *best, held is not None)], columns=["package", "page_id", "pos", "source_url", "corrects"])

    def close(self) -> None:
        pass


def first_sources_so_far(refs: DataFrame) -> DataFrame:
    """(package, page_id, pos, source_url, corrects): a package's first source, and each one that corrects it later."""
    rows = refs.select("package", F.col("page_id").cast("long").alias("page_id"), F.col("pos").cast("long").alias("pos"), "source_url").where("package is not null")
    reduced = rows.mapInArrow(_least, SOURCE)
    return reduced.groupBy("package").transformWithStateInPandas(FirstSource(), _OUT, "Update", "None")


def latest_sources(put_out: DataFrame) -> DataFrame:
    """Each package once, with the source that its last correction left: the least that was put out."""
    return put_out.groupBy("package").agg(F.min_by("source_url", F.struct("page_id", "pos")).alias("source_url"))
