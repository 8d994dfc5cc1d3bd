"""Bounded-space online packing of documents into token sequences.

Each partition keeps a fixed number of open windows. A piece goes to the open
window that it fits best; when none has room, the fullest window is emitted and
a new one opened. What stays open at the end of the partitions is merged in
groups of MERGE partitions, largest piece first, and the windows that this leaves
with a gap of LEFT_GAP or more in groups of MERGE_LEFT such groups. Only piece
descriptions are shuffled, never token ids.

Defined cases: a null or empty text is the end token alone; a repeated row is
packed again; an empty table gives no pieces; other columns are ignored; a text
longer than a window is cut into whole windows and a rest.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import stage_table

SEQUENCE = 2048
END_ID = 1
OPEN_WINDOWS = 64
#: A gap of at least this many tokens in a window about to be emitted takes the head of the next piece.
CUT_GAP = 48
#: Partitions whose leftovers are merged together, and such groups whose leftovers are.
MERGE, MERGE_LEFT = 4, 16
#: The gap from which a merged window is merged once more.
LEFT_GAP = 256
_FIELDS = [
    pa.field("doc_id", pa.int64()),
    pa.field("start", pa.int64()),
    pa.field("length", pa.int64()),
    pa.field("ids_crc32", pa.int64()),
    pa.field("doc_tokens", pa.int64()),
    pa.field("sequence_id", pa.int64()),
    pa.field("offset", pa.int64()),
]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_level_encoding(path: str):
    """An encoder with the vocabulary and ids of a byte-level BPE file in JSON.

    The ids are those of the tokenizers library (tests compare them) if the
    file's added tokens are allowed, as it reads them wherever a text spells
    them; this encoder is several times as fast on unseen words.
    """
    import public_tokenizers
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char_to_byte = {chr(b): b for b in shown}
    char_to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    ranks = {bytes(char_to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class _Windows:
    """The open windows of one task, ordered by the room left in each."""

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next_id = size, limit, first_id
        self.gaps: list[tuple[int, int]] = []
        self.used: dict[int, int] = {}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def put(self, window: int, length: int) -> int:
        at = self.used.get(window, 0)
        self.used[window] = at + length
        if at + length < self.size:
            bisect.insort(self.gaps, (self.size - at - length, window))
        else:
            del self.used[window]
        return at

    def best(self, length: int) -> int | None:
        i = bisect.bisect_left(self.gaps, (length, -1))
        return self.gaps.pop(i)[1] if i < len(self.gaps) else None

    def fullest(self) -> tuple[int, int]:
        return self.gaps.pop(0)


def _packer(tokenizer: str, size: int, open_windows: int, cut_gap: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_level_encoding(tokenizer).encode_to_numpy
        part = TaskContext.get().partitionId()
        windows = _Windows(size, open_windows, part << 32)
        held: dict[int, list[tuple]] = {}

        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, allowed_special="all") if text else np.empty(0, np.uint32)
                ids = np.append(ids, end_id).astype("<u4")
                n, at = len(ids), 0

                def piece(window: int, offset: int, length: int, start: int, doc=doc, ids=ids, n=n) -> tuple:
                    return (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), n, window, offset)

                while n - at >= size:
                    out.append(piece(windows.new_id(), 0, size, at))
                    at += size
                while at < n:
                    take = n - at
                    window = windows.best(take)
                    if window is None and len(windows.gaps) >= open_windows:
                        gap, full = windows.fullest()
                        rows = held.pop(full)
                        if gap >= cut_gap:
                            rows.append(piece(full, size - gap, gap, at))
                            at += gap
                        del windows.used[full]
                        out += rows
                        continue
                    if window is None:
                        window = windows.new_id()
                    held.setdefault(window, []).append(piece(window, windows.put(window, take), take, at))
                    at = n
                    if window not in windows.used:
                        out += held.pop(window)
            yield _rows(out, True, part)
        yield _rows([x for rows in held.values() for x in rows], False, part)

    return run


def _rows(rows: list[tuple], closed: bool, part: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=True)]
    arrays += [pa.array([closed] * len(rows), pa.bool_()), pa.array([part // MERGE] * len(rows), pa.int64())]
    return pa.record_batch(arrays, schema=pa.schema([*_FIELDS, pa.field("closed", pa.bool_()), pa.field("merge_group", pa.int64())]))


def _merger(size: int, first_id: int, left_gap: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        order = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        windows, ids, offsets = _Windows(size, 0, first_id | (group << 32)), [], []
        for length in order.column("length").to_pylist():
            window = windows.best(length)
            window = windows.new_id() if window is None else window
            ids.append(window)
            offsets.append(windows.put(window, length))
        closed = [windows.used.get(x, size) > size - left_gap for x in ids]
        keep = [order.column(f.name) for f in _FIELDS[:5]]
        arrays = [pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()), pa.array(closed, pa.bool_()), pa.array([group // MERGE_LEFT] * len(ids), pa.int64())]
        return pa.table([*keep, *arrays], names=[*[f.name for f in _FIELDS], "closed", "merge_group"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS, cut_gap: int = CUT_GAP, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence and the offset that each got.

    `tokenizer` is the path of a byte-level BPE file in JSON on every worker.
    Every token id, the closing `end_id` included, lies in exactly one piece.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = f"{_DDL}, closed boolean, merge_group long"
    pieces = stage_table(texts.mapInArrow(_packer(tokenizer, size, open_windows, cut_gap, end_id), ddl), "packed")
    merged = stage_table(pieces.where("not closed").groupBy("merge_group").applyInArrow(_merger(size, 1 << 61, LEFT_GAP), ddl), "merged")
    left = merged.where("not closed").groupBy("merge_group").applyInArrow(_merger(size, 1 << 62, LEFT_GAP), ddl)
    done = pieces.where("closed").unionByName(merged.where("closed")).unionByName(left)
    return done.select(*[f.name for f in _FIELDS])
