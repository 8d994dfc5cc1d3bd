"""Exact Jaccard join of shingle sets: size-banded tiles, hashed bitmap signatures, sorted-array intersection.

All sets order their shingles the same way, rarest first by a table of hashed
counts over all documents. Two sets whose similarity reaches the threshold then
share one of the first p shingles of the larger with one of the first q of the
smaller: p and q follow from the sizes, so nothing is lost, unlike with samples.
A shingle that several classes of equal sets begin with is a bucket. As frequent
shingles come last, passages and templates that many documents share are no
buckets, unless hardly anything else is in the texts.

Each class has a bitmap signature: one bit for each hash value, flipped by each
shingle. Bits that differ are at most as many as shingles that only one of two
sets has, so their count bounds the overlap from above, and most pairs of a
bucket are settled by it: with centres, and then in tiles of nodes of like size
(near_duplicates holds these steps, as both joins take them). Bitmaps grow with
their sets, or they would settle nothing between large ones. Pairs of small buckets
are counted first: linked sets share not only one shingle of their prefixes, but as
many as their sizes tell, which few pairs that share one by chance do. The others are
confirmed on the sorted arrays of whole sets. The result is the components of
all links; links inside a component are not listed.

Defined cases: those of near_duplicates. Null and empty texts are linked with
nothing and are components of their own; a text of fewer words than a shingle is
one shingle; repeated rows share a component; a row without id takes the component
of an equal set, else none; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.bytewords import sliced
from claimlens.llm.near_duplicates import PERCENT, ROWS, _mixed, _texts, labelled, shingles
from claimlens.llm.tables import shuffles_dropped

WIDTH = 5
#: Counters of hashed shingles (a byte each, once they are levels, in every task), and the parts in which they are summed.
SLOTS = 1 << 21
PARTS = 64
#: The least 64-bit words of a bitmap signature.
BITMAP_WORDS = 8
#: Sets begin with about a hundred shingles; one in so many is a bucket whose members all meet its centre first.
STAR_PART = 16
#: Shingles that are counted at once.
_COUNTED = 1 << 20


def whole_prefix(n: Any) -> Any:
    """How many shingles of a set of n one of them is shared with any linked set that is no larger."""
    return n - (PERCENT * n + 99) // 100 + 1


def lead_prefix(n: Any) -> Any:
    """How many shingles of a set of n one of them is shared with any linked set that is no smaller."""
    return n - (2 * PERCENT * n + 99 + PERCENT) // (100 + PERCENT) + 1


def bitmaps_close(bits: Any, na: Any, nb: Any) -> Any:
    """Whether sets of these sizes may be linked: shingles of only one of them are at least as many as the differing bits."""
    return (100 + PERCENT) * bits <= (100 - PERCENT) * (na + nb)


def least_shared(na: Any, nb: Any) -> Any:
    """How many shingles linked sets of sizes na >= nb share at least among the smaller's lead prefix and the larger's whole one.

    Of the prefix that ends first in the common order, shingles in the other set
    are in the other prefix too; beyond it, as many as are left may be shared.
    """
    overlap = (PERCENT * (na + nb) + 99 + PERCENT) // (100 + PERCENT)
    return np.minimum(overlap - (nb - lead_prefix(nb)), overlap - (na - whole_prefix(na)))


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SLOTS, np.uint32), [], 0
        for text in (text for batch in batches for piece in sliced(batch, 0) for text in piece.column(0).to_pylist()):
            held.append(shingles(text, width))
            size += len(held[-1])
            if size >= _COUNTED:
                total += np.bincount((np.concatenate(held) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
                held, size = [], 0
        if held:
            total += np.bincount((np.concatenate(held) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        rows = [x.astype(np.min_scalar_type(x.max())) for x in np.split(total, PARTS)]
        yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([x.dtype.itemsize for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], names=["part", "bytes", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, size, counts in zip(*[batch.column(c).to_pylist() for c in ("part", "bytes", "counts")], strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts, f"u{size}").astype(np.int64)
    levels = [np.minimum(np.ceil(8 * np.log2(np.maximum(x, 1))), 255).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["part", "levels"])


def slot_levels(texts: DataFrame, width: int) -> np.ndarray:
    """For each slot of hashed shingles the logarithm of their number over all texts, in eighths: SLOTS bytes."""
    partial = texts.select("text").mapInArrow(_counts(width), "part int, bytes int, counts binary")
    found = partial.repartition(PARTS, "part").mapInArrow(_summed, "part int, levels binary").collect()
    out = np.zeros((PARTS, SLOTS // PARTS), np.uint8)
    for r in found:
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def bitmap(s: np.ndarray) -> np.ndarray:
    """A power of two of bits, 2 to 4 a shingle: with fewer, those of any two large sets would differ in less bits than the bound allows."""
    size = 64 * max(BITMAP_WORDS, 1 << (max(2 * len(s), 1) - 1 >> 6).bit_length())
    odd = np.bincount((_mixed(s) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signed(width: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, 2)):
            rows: list[tuple] = []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                # Shingles come in the order of their hashes, which settles ties.
                order = np.argsort(levels[(s % np.uint64(SLOTS)).astype(np.int64)], kind="stable")
                first = s[order[: whole_prefix(len(s))]] if len(s) else s
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bitmap(s), first.view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "text_hash", "n", "set_hash", "sketch", "bands"])

    return run


def _members(classes: DataFrame) -> DataFrame:
    """The shingles that each node begins with; in the first of them it leads, that is, may be the smaller set of a pair."""
    lead = F.expr(f"n - (({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT}) + 1")
    return classes.select("node", lead.alias("leads"), F.posexplode("bands").alias("pos", "bucket")).select("node", "bucket", (F.col("pos") < F.col("leads")).alias("lead"))


def join_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    texts = _texts(docs, id_col, text_col)
    with shuffles_dropped(docs.sparkSession):
        signed = texts.mapInArrow(_signed(width, slot_levels(texts, width)), ROWS)
        found = labelled(texts, signed, width, _members, bitmaps_close, star_part=STAR_PART, need=least_shared)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
