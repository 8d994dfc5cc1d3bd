"""Removing repeated passages by a distributed merge of sorted suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts in a document
with a smaller id. Texts are packed into runs of some megabytes. Suffixes are
sampled where the hash of GRAM bytes is the least among those of one string of
LENGTH bytes, so equal strings have a sampled suffix at the same place, about
one byte in sixteen. A first exchange of these hashes alone, one sorted list a
run, leaves the suffixes whose gram occurs twice.

Each run sorts those by what follows, front-codes them (each entry holds only
the bytes that it does not share with the one before) and sends them by ranges
of the gram's hash, which keep the ranges even and equal grams together. Each
range merges its runs with a loser tree whose players carry the length of the
prefix that they share with the last winner: prefixes known to be equal are
never compared again, and the merge yields the common prefixes of neighbours.
With the bytes before each suffix, they say which strings occur in which
smallest document.

A run sends one entry for all its documents with the same bytes around a
suffix, and marks the others itself, so a passage that a third of all documents
share arrives once a run. Documents equal to an earlier one as a whole are set
apart before.

Defined cases: a null text is empty; a row without id removes nothing and keeps
all its bytes; rows of one id do not remove each other's bytes; an empty table
gives an empty result; other columns are ignored or, in `remove_passages`,
carried along, with characters that a cut splits left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import restrict, stage_table

LENGTH = 50
GRAM = 20
#: Grams inside one string of LENGTH bytes, and most bytes of it before a suffix.
SPAN = LENGTH - GRAM + 1
RUN_BYTES = 5_000_000
BLOCK_BYTES = 500_000
#: Bytes of text for each range of hashes.
RANGE_BYTES = 10_000_000
#: Bytes of front-coded suffixes sent on at once.
BATCH_BYTES = 1_000_000
_KEY_BITS = 40
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = (np.random.default_rng(50).integers(0, 1 << 63, 256, np.uint64) << np.uint64(1)) | np.uint64(1)
_RUN = "run_id long, size long, ids binary, live binary, lengths binary, body binary"


def _pack(a: np.ndarray) -> bytes:
    """An array with its bytes of equal rank side by side, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, bytes]] = []
    size = 0

    def full() -> pa.RecordBatch:
        nonlocal made, held, size
        held.sort(key=lambda x: (x[0] is None, x[0] or 0))
        ids = np.array([x[0] or 0 for x in held], np.int64)
        live = np.array([x[0] is not None for x in held], np.uint8)
        lengths = np.array([len(x[1]) for x in held], np.int64)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(x[1] for x in held))
        row = [(part << 24) | made, size, _pack(ids), _pack(live), _pack(lengths), body]
        made, held, size = made + 1, [], 0
        return pa.record_batch([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[2:]]], names=["run_id", "size", "ids", "live", "lengths", "body"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            held.append((doc, raw))
            size += len(raw)
            if size >= RUN_BYTES:
                yield full()
    if held:
        yield full()


class _Run:
    """The texts of a run, in the order of their ids, as one array of bytes."""

    def __init__(self, row: dict):
        self.ids, self.live = _unpack(row["ids"], np.int64), _unpack(row["live"], np.uint8).astype(bool)
        self.lengths = _unpack(row["lengths"], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.body = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(row["size"]))), np.uint8)

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the sampled suffixes, the documents that they are in, and the leading bits of their grams' hashes."""
        places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        first = 0
        while first < len(self.ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + BLOCK_BYTES)))
            a, b = int(self.starts[first]), int(self.ends[last - 1])
            p, k = _sampled(self.body[a:b], self.starts[first:last] - a, np.where(self.live[first:last], self.ends[first:last] - a, self.starts[first:last] - a))
            places.append(p + a), keys.append(k)
            first = last
        place, key = np.concatenate(places), np.concatenate(keys)
        return place, np.searchsorted(self.ends, place, side="right"), key


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def _sampled(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = {1: _BYTE[text]}
    for n in (1, 2, 4, 8):
        h[2 * n] = h[n][:-n] * _power(n) + h[n][n:]
    g = h[16][: 16 - GRAM] * _power(GRAM - 16) + h[GRAM - 16][16:]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    low = g
    for n in (1, 2, 4, 8):
        low = np.minimum(low[:-n], low[n:])
    low = np.minimum(low[: -(SPAN - 16)], low[SPAN - 16 :])
    # Strings that would cross into the next text count for nothing.
    inside = np.zeros(len(low) + 1, np.int8)
    whole = ends - starts >= LENGTH
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - LENGTH + 1, -1)
    low = np.where(np.cumsum(inside[:-1]) > 0, low, np.uint64(0))
    high = np.concatenate([np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)])
    for n in (1, 2, 4, 8):
        high = np.maximum(high[:-n], high[n:])
    high = np.maximum(high[: -(SPAN - 16)], high[SPAN - 16 :])
    at = np.flatnonzero((high == g) & (high > 0))
    # The least hashes have few leading bits; mixed once more, they spread over all keys.
    return at, (g[at] * _power(2)) >> np.uint64(64 - _KEY_BITS)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys.astype(np.float64) * (ranges / (1 << _KEY_BITS))).astype(np.int64)


def _slices(r: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, start, end) of each range that sorted r holds: work grows with the run, not with the number of ranges."""
    found, start = np.unique(r, return_index=True)
    return list(zip(found.tolist(), start.tolist(), np.append(start[1:], len(r)).tolist(), strict=True))


def _sent(rows: list[tuple[int | None, int, bytes]], name: str) -> pa.RecordBatch:
    ranges, runs, payloads = zip(*rows, strict=True)
    return pa.record_batch([pa.array(ranges, pa.int64()), pa.array(runs, pa.int64()), pa.array(payloads, pa.binary())], names=["range", "run_id", name])


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _keys(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows_of(batch):
                keys = np.unique(_Run(row).samples()[2])
                if len(keys):
                    yield _sent([(r, row["run_id"], _pack(keys[a:b])) for r, a, b in _slices(_range_of(keys, ranges))], "keys")

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each run, the keys that another run has too."""
    lists = [_unpack(b, np.uint64) for b in table.column("keys").to_pylist()]
    keys, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = keys[counts > 1]
    kept = [k[np.isin(k, shared, assume_unique=True)] for k in lists]
    some = [i for i, k in enumerate(kept) if len(k)]
    return pa.table([table.column("run_id").take(pa.array(some, pa.int64())), pa.array([_pack(kept[i]) for i in some], pa.binary())], names=["run_id", "keys"])


def _words(text: np.ndarray, at: np.ndarray, before: bool, limit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of `width` bytes from each place, going forward or backward, zero past the text's border; and how many are real."""
    real = np.clip(np.where(before, at - limit, limit - at), 0, width)
    steps = np.arange(width)
    rows = np.zeros((len(at), width), np.uint8)
    for k in range(0, len(at), 8192):  # places of all bytes at once would take eight times the rows
        a = at[k : k + 8192, None]
        i = a - 1 - steps if before else a + steps
        rows[k : k + 8192] = np.where(steps < real[k : k + 8192, None], text[np.clip(i, 0, max(0, len(text) - 1))], 0)
    return rows, real


def _sort_words(rows: np.ndarray) -> list[np.ndarray]:
    """The rows as big-endian words, last word first, as lexsort wants them."""
    padded = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
    return list(np.ascontiguousarray(padded).view(">u8").astype(np.uint64).T[::-1])


def _all_windows(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit j is set if the string that starts j bytes before the suffix lies inside the text."""
    mask = np.zeros(len(left), np.uint32)
    for j in range(SPAN):
        mask |= ((left >= j) & (right >= LENGTH - j)).astype(np.uint32) << np.uint32(j)
    return mask


def _entries(ranges: int):
    """Front-coded sorted suffixes of each run by range, and what a run can tell alone (range null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows_of(batch):
                yield from one(row)

    def one(row: dict) -> Iterator[pa.RecordBatch]:
        own = _Run(row)
        place, doc, key = own.samples()
        shared = np.concatenate([_unpack(b, np.uint64) for b in row["found"] or []] or [np.zeros(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        k, d = key[order], own.ids[doc[order]]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(k)) - 1
        local = np.repeat(d[new] != d[last], last - new + 1) if len(k) else np.zeros(0, bool)
        chosen = np.zeros(len(key), bool)
        chosen[order] = local
        chosen |= np.isin(key, shared)
        place, doc, key = place[chosen], doc[chosen], key[chosen]
        if not len(place):
            return
        right, n_right = _words(own.body, place, False, own.ends[doc], LENGTH)
        left, n_left = _words(own.body, place, True, own.starts[doc], SPAN - 1)
        r = _range_of(key, ranges)
        rw, lw = _sort_words(right), _sort_words(left)
        o = np.lexsort([place, n_left, n_right, *lw, *rw, r])
        same = np.ones(len(o) - 1, bool)
        for x in (r, n_right, n_left, *rw, *lw):
            same &= x[o][1:] == x[o][:-1]
        head = np.concatenate([[True], ~same])
        group = np.flatnonzero(head)[np.cumsum(head) - 1]
        ids = own.ids[doc[o]]
        later = ids > ids[group]
        told = o[later]
        yield _sent([(None, row["run_id"], _marks(doc[told], place[told] - own.starts[doc[told]], _all_windows(n_left[told], n_right[told])))], "payload")
        o = o[~later]
        out, size = [], 0
        for i, a, b in _slices(r[o]):
            e = o[a:b]
            out.append((i, row["run_id"], _front_coded(right[e], n_right[e], left[e], n_left[e], own.ids[doc[e]], doc[e], place[e] - own.starts[doc[e]])))
            size += len(out[-1][2])
            if size >= BATCH_BYTES:
                yield _sent(out, "payload")
                out, size = [], 0
        if out:
            yield _sent(out, "payload")

    return run


def _bundle(parts: list[bytes]) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<u4").tobytes(), *parts])


def _unbundle(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, "<u4", 1)[0])
    lengths = np.frombuffer(b, "<u4", n, 4)
    ends = np.cumsum(lengths, dtype=np.int64) + 4 * (n + 1)
    return [b[e - size : e] for e, size in zip(ends.tolist(), lengths.tolist(), strict=True)]


def _marks(doc: np.ndarray, at: np.ndarray, mask: np.ndarray) -> bytes:
    return _bundle([_pack(doc.astype(np.int64)), _pack(at.astype(np.int64)), _pack(mask.astype(np.uint32))])


def _front_coded(right, n_right, left, n_left, ids, doc, at) -> bytes:
    shared = np.zeros(len(right), np.int64)
    equal = right[1:] == right[:-1]
    shared[1:] = np.where(equal.all(axis=1), LENGTH, equal.argmin(axis=1))
    steps = np.arange(LENGTH)
    tails = right[steps >= shared[:, None]]
    compress = zstandard.ZstdCompressor(level=3).compress
    return _bundle([_pack(shared.astype(np.uint8)), compress(tails.tobytes()), _pack(n_right.astype(np.uint8)), compress(left.tobytes()), _pack(n_left.astype(np.uint8)), _pack(ids), _pack(doc.astype(np.int64)), _pack(at.astype(np.int64))])


def _decoded(payload: bytes) -> dict:
    parts = _unbundle(payload)
    expand = zstandard.ZstdDecompressor().decompress
    shared = _unpack(parts[0], np.uint8).astype(np.int64)
    n = len(shared)
    right = np.zeros((n, LENGTH), np.uint8)
    steps = np.arange(LENGTH)
    own = steps >= shared[:, None]
    right[own] = np.frombuffer(expand(parts[1]), np.uint8)
    # Each byte comes from the last entry that wrote its column.
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), axis=0)
    return {
        "right": right[source, steps],
        "shared": shared,
        "n_right": _unpack(parts[2], np.uint8).astype(np.int64),
        "left": np.frombuffer(expand(parts[3]), np.uint8).reshape(n, SPAN - 1),
        "n_left": _unpack(parts[4], np.uint8).astype(np.int64),
        "id": _unpack(parts[5], np.int64),
        "doc": _unpack(parts[6], np.int64),
        "at": _unpack(parts[7], np.int64),
    }


def _mismatch(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return LENGTH - (x.bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of strings of LENGTH bytes, each with the prefixes shared with the string before.

    Returns (run, index) in sorted order, and the prefix that each shares with
    the one before it. A loser tree: a player that shares more with the last
    winner than another comes before it, without a look at their bytes; equal
    players are compared from that prefix on.
    """
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    strings = [r[0] for r in runs] + [[]] * (size - len(runs))
    shares = [r[1] for r in runs] + [[]] * (size - len(runs))
    at = [0] * size
    text: list[bytes | None] = [s[0] if s else None for s in strings]
    lcp = [0] * size
    tree = [0] * size

    def beats(a: int, b: int) -> bool:
        """Whether a comes first; the other then shares with a what is found here."""
        if text[b] is None or text[a] is None:
            return text[a] is not None or text[b] is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        if text[a] == text[b]:
            first = a < b
            lcp[b if first else a] = LENGTH
            return first
        n = _mismatch(text[a], text[b], lcp[a])
        first = text[a][n] < text[b][n]
        lcp[b if first else a] = n
        return first

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        winner = a if beats(a, b) else b
        tree[node] = b if winner == a else a
        return winner

    winner = build(1) if size > 1 else 0
    order: list[tuple[int, int]] = []
    prefixes: list[int] = []
    while text[winner] is not None:
        i = at[winner]
        order.append((winner, i))
        prefixes.append(lcp[winner])
        at[winner] = i = i + 1
        if i < len(strings[winner]):
            text[winner], lcp[winner] = strings[winner][i], shares[winner][i]
        else:
            text[winner] = None
        node = (winner + size) // 2
        while node:
            other = tree[node]
            if text[other] is not None and (text[winner] is None or lcp[other] > lcp[winner] or (lcp[other] == lcp[winner] and not beats(winner, other))):
                tree[node], winner = winner, other
            node //= 2
    return order, prefixes


def _resolved(table: pa.Table) -> pa.Table:
    """For each run, the strings around its suffixes that also occur in a smaller document."""
    found = [_decoded(b) for b in table.column("payload").to_pylist()]
    strings = [(list(map(bytes, f["right"])), f["shared"].tolist()) for f in found]
    order, prefixes = merged(strings)
    run = np.fromiter((x[0] for x in order), np.int64, len(order))
    base = np.cumsum([0, *[len(f["shared"]) for f in found]])[:-1]
    flat = base[run] + np.fromiter((x[1] for x in order), np.int64, len(order))
    prefix = np.array(prefixes, np.int64)
    all_of = {c: np.concatenate([f[c] for f in found])[flat] for c in ("n_right", "left", "n_left", "id", "doc", "at")}
    del found, strings, order, prefixes
    mask = np.zeros(len(flat), np.uint32)
    before = np.zeros(len(flat), np.uint64)
    for j in range(SPAN):
        if j:
            before = (before + _BYTE[all_of["left"][:, j - 1]]) * _power(1)
            before ^= before >> np.uint64(29)
        group = np.cumsum(prefix < LENGTH - j).astype(np.uint64)
        valid = np.flatnonzero((all_of["n_left"] >= j) & (all_of["n_right"] >= LENGTH - j))
        if len(valid) < 2:
            continue
        name = (before[valid] ^ (group[valid] * _power(3))) * _power(1)
        o = np.argsort(name, kind="stable")
        name, ids = name[o], all_of["id"][valid][o]
        start = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        least = np.repeat(np.minimum.reduceat(ids, start), np.diff(np.append(start, len(ids))))
        mask[valid[o[ids > least]]] |= np.uint32(1 << j)
    rows = []
    for i, run_id in enumerate(table.column("run_id").to_pylist()):
        own = np.flatnonzero((run == i) & (mask > 0))
        if len(own):
            rows.append((run_id, _marks(all_of["doc"][own], all_of["at"][own], mask[own])))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["run_id", "payload"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_sha256", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        for row in _rows_of(batch):
            own = _Run(row)
            n = len(own.body)
            marks = [_unbundle(b) for b in row["found"] or []]
            doc, at = (np.concatenate([np.zeros(0, np.int64), *[_unpack(m[k], np.int64) for m in marks]]) for k in (0, 1))
            mask = np.concatenate([np.zeros(0, np.uint32), *[_unpack(m[2], np.uint32) for m in marks]])
            place = own.starts[doc] + at
            start = np.concatenate([place[mask & np.uint32(1 << k) > 0] - k for k in range(SPAN)])
            start = np.unique(start)
            # Disjoint spans: a string that begins beyond the end of the one before opens a new one.
            apart = start[1:] > start[:-1] + LENGTH
            step = np.zeros(n + 1, np.int8)
            step[start[np.concatenate([np.ones(min(1, len(start)), bool), apart])]] = 1
            step[start[np.concatenate([apart, np.ones(min(1, len(start)), bool)])] + LENGTH] -= 1
            gone = np.cumsum(step[:n], dtype=np.int8) > 0
            total = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            opening = own.starts[own.lengths > 0]
            first[opening] = gone[opening]
            edges = np.concatenate([np.zeros(1, np.int32), np.cumsum(first, dtype=np.int32)])
            out = []
            for i in range(len(own.ids)):
                a, b = int(own.starts[i]), int(own.ends[i])
                raw = own.body[a:b]
                removed = int(total[b] - total[a])
                kept = raw[~gone[a:b]].tobytes() if removed else raw.tobytes()
                out.append((int(own.ids[i]) if own.live[i] else None, hashlib.sha256(raw.tobytes()).hexdigest(), b - a, removed, int(edges[b] - edges[a]), kept))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_OUT = "doc_id long, text_sha256 string, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 (of the whole text), n_bytes, n_removed, n_spans and kept (the remaining bytes) for every row."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(raw, 256).alias("sha"), F.length(raw).alias("n"))
    digests = stage_table(digests.where(f"n >= {LENGTH} and doc_id is not null").select("doc_id", "sha"), "digests")
    firsts = digests.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # Rows whose whole text is an earlier row's leave here; an id that has other texts too stays with the rest.
    later = digests.join(firsts, "sha").where("doc_id > low").select("doc_id")
    rows = digests.join(later.distinct(), "doc_id", "left_semi").groupBy("doc_id").count()
    copies = later.groupBy("doc_id").agg(F.count("*").alias("n")).join(rows, "doc_id").where(F.col("n") == F.col("count")).select("doc_id")
    copies = stage_table(copies, "whole-copies")
    left = restrict(texts, copies, "doc_id", "left_anti")
    again = restrict(texts, copies, "doc_id").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    short = F.length("raw") < LENGTH
    size = F.length("raw").cast("long")
    again = again.select("doc_id", F.sha2("raw", 256).alias("text_sha256"), size.alias("n_bytes"), F.when(short, 0).otherwise(size).cast("long").alias("n_removed"), F.when(short, 0).otherwise(1).cast("long").alias("n_spans"), F.when(short, F.col("raw")).otherwise(F.lit(b"")).alias("kept"))

    runs = stage_table(left.mapInArrow(_runs, _RUN), "runs")
    total = runs.agg(F.sum("size")).first()[0] or 0
    ranges = max(8, -(-total // RANGE_BYTES))
    keys = runs.mapInArrow(_keys(ranges), "range long, run_id long, keys binary")
    repeated = keys.groupBy("range").applyInArrow(_repeated, "run_id long, keys binary")
    repeated = repeated.groupBy("run_id").agg(F.collect_list("keys").alias("found"))
    sent = runs.join(repeated, "run_id", "left").mapInArrow(_entries(ranges), "range long, run_id long, payload binary")
    sent = stage_table(sent, "suffix-runs")
    told = sent.where("range is not null").groupBy("range").applyInArrow(_resolved, "run_id long, payload binary")
    marks = sent.where("range is null").select("run_id", "payload").unionByName(told)
    marks = marks.groupBy("run_id").agg(F.collect_list("payload").alias("found"))
    return runs.join(marks, "run_id", "left").mapInArrow(_cut, _OUT).unionByName(again)


def remove_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their texts, and their own columns."""
    cut = cut_documents(docs, id_col=id_col, text_col=text_col).where("n_removed > 0")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_sha256"), pa.array(text, pa.string())], names=["__id", "__sha", "__text"])

    new = cut.select("doc_id", "text_sha256", "kept").mapInArrow(decoded, "__id long, __sha string, __text string")
    new = stage_table(new.dropDuplicates(["__id", "__sha"]), "cut-texts")
    ids = new.select("__id").distinct()
    # Texts that stay as they are do not move.
    untouched = restrict(docs, ids, id_col, "left_anti")
    touched = restrict(docs, ids, id_col).withColumn("__own", F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256))
    others = [c for c in docs.columns if c != text_col]
    kept = touched.join(new.select("__id", "__sha"), (touched[id_col].cast("long") == F.col("__id")) & (touched["__own"] == F.col("__sha")), "left_anti").select(*docs.columns)
    moved = touched.select(*others, "__own").join(new, (touched[id_col].cast("long") == new["__id"]) & (touched["__own"] == new["__sha"]))
    out = {c: F.col(c) for c in others} | {text_col: F.col("__text")}
    if "n_chars" in out:
        out["n_chars"] = F.char_length("__text").cast(docs.schema["n_chars"].dataType)
    moved = moved.select(*[out[c].alias(c) for c in docs.columns])
    return untouched.unionByName(kept).unionByName(moved)
