"""Words of Arrow string columns, found in their UTF-8 bytes by a lookup table and differences.

A word is a run of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. UTF-8 marks every byte of a character beyond ASCII by its top bit, so
that runs of bytes are runs of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes that are worked on at once; a longer text stands alone.
SLICE_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _table() -> np.ndarray:
    """For each byte the lower-cased byte if words hold it, else 0."""
    out = np.zeros(256, np.uint8)
    for low, high, shift in ((0x30, 0x39, 0), (0x41, 0x5A, 32), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
        out[low : high + 1] = np.arange(low, high + 1) + shift
    return out


LOWERED = _table()


@dataclass
class Words:
    """Words of some texts in order: where each starts in `data` (lower-cased bytes, 0 between words), its length, its text."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    n_texts: int

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()


def words(column: pa.Array) -> Words:
    """The words of a string column; a null text has none."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = LOWERED[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = data != 0
    # Whether a byte goes on with the word of the byte before it.
    goes_on = np.zeros(len(data) + 1, bool)
    goes_on[1:-1] = inside[1:] & inside[:-1]
    goes_on[offsets] = False
    starts = np.flatnonzero(inside & ~goes_on[:-1])
    ends = np.flatnonzero(inside & ~goes_on[1:]) + 1
    return Words(data, starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1, len(texts))


def sliced(batch: pa.RecordBatch, column: int, most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts in this column hold about SLICE_BYTES at most."""
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        until = min(until, len(texts), at + most_rows if most_rows else len(texts))
        yield batch.slice(at, until - at)
        at = until


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hashes(found: Words) -> np.ndarray:
    """A 64-bit hash of each word: the mixed sum of a random value for each byte and place."""
    if not len(found.starts):
        return np.zeros(0, np.uint64)
    first = np.cumsum(found.lengths) - found.lengths
    place = np.arange(int(found.lengths.sum()), dtype=np.uint64) - np.repeat(first, found.lengths).astype(np.uint64)
    values = mixed((place << np.uint64(8)) + found.data[found.data != 0] + np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(values, first))
