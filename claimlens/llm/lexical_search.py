"""Ranked lexical search over a two-level quantised index.

The index has a row for each block of documents: the terms of the block in order
of their hashes, and for each posting the document's place in the block, its
impact and its exact number of occurrences. A posting's impact is an integer
function of that number and the document's length. The first level holds it as
one byte, rounded up, which costs a byte a posting and bounds scores from both
sides; the second level holds what gives it exactly.

A search sends a block of queries to all tasks. For each query a task adds up the
bytes of its postings, weighted, and finds the kth highest lower bound; every
document whose upper bound reaches that (and the kth exact score met so far) is
scored again in exact integers from the second level. So no document that belongs
to a task's k highest is lost, however many share a bound; a task puts out its k
highest of each query, and the highest of all follow from two rounds of partial
rankings, the first one dealt by random parts of each query. Whatever its copies,
a document is read once.

A term's weight needs only the number of documents that hold it; for the queries'
terms it is summed over the blocks. Terms are told apart by 64-bit hashes: that any
of 10^4 query terms meets another one of 10^10 terms has a chance of 5e-6.

Defined cases: a null, empty or wordless text, in documents or queries, has no
terms and is in no result; a text of any length is one document, whole; equal
scores go by ascending id, rows without id last; repeated rows rank one after the
other; repeated queries are answered each; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.bytewords import hashes, sliced, words
from claimlens.llm.tables import stage_table

K = 50
#: Documents of a block at most, besides the bound on its bytes.
BLOCK_ROWS = 16_384
#: Impacts lie below SCALE; a byte stands for STEP of them.
SCALE = 1_000_000
STEP = -(-SCALE // 255)
#: Query terms, with repeats among queries, that travel with the tasks of one search (16 bytes each).
QUERY_TERMS = 200_000
SALTS = 16

_INDEX = "doc_id array<long>, n array<int>, terms binary, ends binary, docs binary, impacts binary, tfs binary"


@dataclass(frozen=True)
class Index:
    """Blocks of documents, and what all documents hold: N with a term, L terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for piece in sliced(batch, 0):
            found = words(piece.column(0))
            docs += len(np.unique(found.text))
            terms += len(found.text)
    yield pa.record_batch([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Exact impacts of tf occurrences in a document of n terms."""
    m = 50 + (50 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _blocks(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, 1, BLOCK_ROWS):
                found = words(piece.column(1))
                n = np.bincount(found.text, minlength=found.n_texts)
                h = hashes(found)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], found.text[order]
                new_term = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                at = np.flatnonzero(new_term | np.concatenate([[True], doc[1:] != doc[:-1]])) if len(h) else np.zeros(0, np.int64)
                tf, doc = np.diff(np.append(at, len(h))), doc[at]
                begins = np.flatnonzero(new_term[at])
                bound = -(-impacts(tf, n[doc], n_docs, n_terms) // STEP)
                row = [piece.column(0).to_pylist(), n, h[at][begins].tobytes(), np.append(begins[1:], len(at))[: len(begins)].astype(np.int32).tobytes(), doc.astype(np.int16).tobytes(), bound.astype(np.uint8).tobytes(), tf.astype(np.int32).tobytes()]
                types = (pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5)
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["doc_id", "n", "terms", "ends", "docs", "impacts", "tfs"])

    return run


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows, staged."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sums = texts.select("text").mapInArrow(_lengths, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    n_docs, n_terms = sums["docs"] or 0, sums["terms"] or 0
    # Small row groups, as a reader takes many rows of one at once.
    blocks = stage_table(texts.mapInArrow(_blocks(n_docs, n_terms), _INDEX), "lexical-index", options={"parquet.block.size": 16 << 20})
    return Index(blocks, n_docs, n_terms)


def _frequencies(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for keys, ends in zip(batch.column(0), batch.column(1), strict=True):
                _, sizes, which = _postings(keys, ends, terms)
                total[which] += sizes
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["term", "n"])

    return run


def _postings(keys: pa.Scalar, ends: pa.Scalar, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the postings of the block's query terms begin, their numbers, and which of the terms they are."""
    keys, ends = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(ends.as_buffer(), np.int32)
    at = np.searchsorted(keys, terms)
    which = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == terms) if len(keys) else np.zeros(0, np.int64)
    at = at[which]
    begins = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0)
    return begins, ends[at] - begins, which


def _weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Highest:
    """The k highest exact scores of a query, and their documents."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.doc, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document has to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        score, doc, missing = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.missing, missing)))
        order = np.lexsort((doc, missing, -score))[: self.k]
        order = order[score[order] > 0]
        self.score, self.doc, self.missing = score[order], doc[order], missing[order]


def _search(terms: np.ndarray, weights: np.ndarray, queries: list[np.ndarray], n_docs: int, n_terms: int, k: int):
    """queries: for each the places of its terms in `terms`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Highest(k) for _ in queries]
        for batch in batches:
            ids, lengths = batch.column("doc_id"), batch.column("n")
            for i in range(batch.num_rows):
                doc = ids[i].values
                missing = np.asarray(doc.is_null())
                doc, n = np.asarray(doc.fill_null(0)), np.asarray(lengths[i].values).astype(np.int64)
                begins, sizes, which = _postings(batch.column("terms")[i], batch.column("ends")[i], terms)
                docs, bounds, tfs = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("docs", np.int16), ("impacts", np.uint8), ("tfs", np.int32)))
                slot = np.full(len(terms), -1)
                slot[which] = np.arange(len(which))
                for own, top in zip(queries, best, strict=True):
                    here = [(int(weights[t]), begins[s], begins[s] + sizes[s]) for t, s in zip(own.tolist(), slot[own].tolist(), strict=True) if s >= 0 and weights[t] > 0]
                    if not here:
                        continue
                    summed, held = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
                    for w, a, b in here:
                        summed[docs[a:b]] += w * bounds[a:b].astype(np.int64)
                        held[docs[a:b]] += w * (bounds[a:b] > 0)
                    upper, least = STEP * summed, top.least
                    lower = upper - (STEP - 1) * held
                    if len(doc) > k:
                        least = max(least, int(np.partition(lower, len(doc) - k)[len(doc) - k]))
                    chosen = np.flatnonzero(upper >= least)
                    if not len(chosen):
                        continue
                    exact = np.zeros(len(chosen), np.int64)
                    for w, a, b in here:
                        at = np.minimum(np.searchsorted(docs[a:b], chosen), b - a - 1)
                        hit = np.flatnonzero(docs[a:b][at] == chosen)
                        exact[hit] += w * impacts(tfs[a:b][at[hit]].astype(np.int64), n[chosen[hit]], n_docs, n_terms)
                    top.add(exact, doc[chosen], missing[chosen])
        number = np.repeat(np.arange(len(queries)), [len(x.score) for x in best])
        doc = pa.array(np.concatenate([x.doc for x in best]), pa.int64(), mask=np.concatenate([x.missing for x in best]))
        yield pa.record_batch([pa.array(number, pa.int64()), doc, pa.array(np.concatenate([x.score for x in best]), pa.int64())], names=["query", "doc_id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = words(batch.column(1))
        own, h = found.text, hashes(found)
        lists = [np.unique(h[slice(*np.searchsorted(own, [i, i + 1]))]).view(np.int64) for i in range(found.n_texts)]
        yield pa.record_batch([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "terms"])


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k highest of each query with their rank: first of its parts, so that no task ranks what all tasks found."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k).drop("salt")


def _answers(index: Index, queries: list[tuple[int | None, np.ndarray]], k: int) -> DataFrame:
    spark = index.blocks.sparkSession
    terms = np.unique(np.concatenate([t for _, t in queries]))
    found = index.blocks.select("terms", "ends").mapInArrow(_frequencies(terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(len(terms), np.int64)
    for r in found:
        weights[r["term"]] = _weight(r["n"], index.n_docs)
    own = [np.searchsorted(terms, t) for _, t in queries]
    rows = index.blocks.mapInArrow(_search(terms, weights, own, index.n_docs, index.n_terms, k), "query long, doc_id long, score long")
    names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(queries)], "query long, item_id long")
    return _ranked(rows, k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def search(index: Index, queries: DataFrame, *, id_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest documents with a score above 0 for each query, in blocks of queries."""
    listed = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_query_terms, "item_id long, terms array<long>").where(F.size("terms") > 0)
    out, block, size = [], [], 0
    for r in listed.toLocalIterator():
        block.append((r["item_id"], np.array(r["terms"], np.int64).view(np.uint64)))
        size += len(r["terms"])
        if size >= QUERY_TERMS:
            out.append(_answers(index, block, k))
            block, size = [], 0
    if block:
        out.append(_answers(index, block, k))
    if not out:
        return queries.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    while len(out) > 1:
        out = [a.unionByName(b) if b is not None else a for a, b in zip(out[::2], [*out[1::2], None][: len(out[::2])], strict=True)]
    return out[0]
