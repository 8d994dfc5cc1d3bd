"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling over Spark.

A word is predicted from a context, the word before it, keyed by its 64-bit hash.
Each context is a restaurant; all share the root restaurant as parent, which
falls back on the uniform distribution over the training vocabulary and one
unknown word. Predictive probabilities are averaged over the sweeps after the
burn-in.

The work is dealt by context, so that restaurants stand whole in one part; parts
share the root only. In a sweep a part empties the dishes of its restaurants in
turn and seats their customers again, given all other tables: an emptied dish is
taken out of the totals of its restaurant and of the root first, and TURNS turns
see what the turns before have seated. The state of a dish is the list of the
customers that opened a table. It is drawn customer by customer, and a Metropolis
test then corrects for the order of drawing, so that a dish is distributed as its
restaurant asks. The tables become the root's customers: they are added up by
ranges of the words' hashes, where the root is seated likewise, and what the root
holds of its words goes back to each part.

A context with more than a quarter of a part's tokens, if that is over 1 / HEAVY
of all (so at most HEAVY contexts), is dealt by context and word, which splits it
over many parts; its totals are broadcast. A dish with as many tokens is dealt by
document as well: its parts add up its customers, and the driver seats it.

Past the first EXACT customers of a dish, more than all but heavy ones have, the
next one to open a table is drawn at once from the product of the chances before
it, which has the same distribution as asking each; tests compare both with the
exact one.

Defined cases: a null text is empty: one end token; repeated rows are scored
alike and count as often as they stand; without training rows every token has
the uniform probability 1; an empty table gives an empty result; a null id is in
no training fold; other columns are ignored.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import drop_staged, remainder, stage_buckets, stage_table, staged_so_far

HEAVY = 1_000_000
HOLDOUT = 10
DISCOUNT, STRENGTH = 0.75, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 10.0
BURN_IN, SWEEPS = 1, 2
TURNS = 5
#: Customers of a dish that are asked one by one; from there on openings are drawn one after the other.
EXACT = 1 << 18
#: Customers whose openings are bits of one word.
MASK = 32
#: Customers that are asked at once, but for those of one dish.
BLOCK_CUSTOMERS = 1 << 18
CHUNK_TOKENS = 1_000_000
#: Documents of a chunk: their numbers and a bit for training fit 16 bits.
CHUNK_DOCS = 32_767
#: Tokens of a part.
PART_TOKENS = 1_000_000
#: Spark's own limit for the buckets of a table; beyond it parts share buckets.
MOST_BUCKETS = 100_000
#: Bytes of texts that are split into words at once (a longer text by itself), and words that are hashed at once.
BLOCK_BYTES = 1 << 21
BLOCK_WORDS = 1 << 16
#: Tokens whose parts are found at once.
BLOCK_TOKENS = 1 << 17
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
SEED = 77
#: The end token's hash; no word is empty, so none has it by its text.
END = xxhash.xxh3_64_intdigest(b"")
#: Stands for a null id inside packed arrays.
NO_ID = -(1 << 63)


def _pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_IN_WORD = np.array([bool(bytes([i]).strip()) for i in range(256)])
#: The bytes of a block that a word of so many more bytes has.
_KEPT_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _word_hashes(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at these places of a text that goes on for eight bytes after the last.

    Eight bytes after eight are mixed in, all words at once; words of equal length up to eight bytes never share a hash.
    """
    out = _mixed(length.astype(np.uint64) * _STEP)
    open_still = np.flatnonzero(length <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        open_still = open_still[length[open_still] > at]
        if not len(open_still):
            break
        block = text[(start[open_still] + at)[:, None] + np.arange(8)].view("<u8")[:, 0]
        block &= _KEPT_BYTES[np.minimum(length[open_still] - at, 8)]
        out[open_still] = _mixed(_mixed((out[open_still] ^ block) * _STEP) * _STEP)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + length[i]].tobytes())
    return out


def _hashed(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, lower-cased from A to Z, and the end token."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    block = np.maximum.accumulate((np.cumsum(sizes) - sizes) // BLOCK_BYTES)
    for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1) if texts else []:
        raw = _LOWER[np.frombuffer(b"\n".join(texts[i] or b"" for i in own) + b"\n" * 9, np.uint8)]
        inside = _IN_WORD[raw].astype(np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0)))
        start, length = edges[::2], edges[1::2] - edges[::2]
        words = np.concatenate([np.empty(0, np.uint64), *[_word_hashes(raw, start[i : i + BLOCK_WORDS], length[i : i + BLOCK_WORDS]) for i in range(0, len(start), BLOCK_WORDS)]])
        upto = np.searchsorted(start, np.cumsum(sizes[own]))
        ends = upto + np.arange(len(own))
        out = np.full(len(words) + len(own), END, np.uint64)
        out[np.delete(np.arange(len(out)), ends)] = words
        yield from np.split(out, ends[:-1] + 1)


def _contexts(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of the word before each, in texts of these sizes; before the first stands the end token."""
    start = np.zeros(len(words), bool)
    start[np.cumsum(sizes) - sizes] = True
    return np.where(start, np.uint64(END), np.concatenate([words[:1], words[:-1]]))


def _dish_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return _mixed(words ^ (contexts * _STEP))


@dataclass(frozen=True)
class Split:
    """Heavy contexts, and heavy dishes by key with their context's place among the former and their word."""

    contexts: np.ndarray
    dishes: np.ndarray
    dish_context: np.ndarray
    dish_word: np.ndarray


def _place(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each value stands in a sorted array, or -1."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _among(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    out = np.empty(len(values), bool)
    for at in range(0, len(values), BLOCK_TOKENS):
        out[at : at + BLOCK_TOKENS] = _place(values[at : at + BLOCK_TOKENS], among) >= 0
    return out


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Whether each value of a sorted array is the first of its kind."""
    out = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=out[1:])
    return out


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about BLOCK_BYTES of this column's texts at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = [*(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK_BYTES)) + 1).tolist(), len(sizes)]
    for a, b in zip([0, *ends], ends, strict=False):
        yield batch.slice(a, b - a)


def _release() -> None:
    """Give freed memory back to the system: an idle worker would keep it beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _releasing(run):
    """A function of batches that gives back what it has freed after each batch that it puts out."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            _release()
        _release()

    return released


def _chunks(lists: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The lists in chunks of about CHUNK_TOKENS tokens, but for longer lists: all their tokens, and their sizes."""
    held, n = [], 0
    for x in lists:
        if held and n + len(x) > CHUNK_TOKENS:
            sizes, tokens = np.fromiter(map(len, held), np.int64, len(held)), np.concatenate(held)
            held, n = [], 0
            yield tokens, sizes
        held.append(x)
        n += len(x)
    if held:
        sizes, tokens = np.fromiter(map(len, held), np.int64, len(held)), np.concatenate(held)
        held = []
        yield tokens, sizes


def _heavy(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk of training rows: all tokens (context null), and contexts (word null) and dishes that make up `share` of them."""
        for h, sizes in (x for batch in batches for x in _chunks(y for piece in _pieces(batch, 0) for y in _hashed(piece.column(0).cast(pa.binary()).to_pylist()))):
            least = max(2.0, share * len(h))
            # Every word is a context once for each time that it is a token.
            words, counts = np.unique(h, return_counts=True)
            often = counts >= least
            context = _contexts(h, sizes)
            within = _among(context, words[often])
            _, first, dishes = np.unique(_dish_keys(h[within], context[within]), return_index=True, return_counts=True)
            many = first[dishes >= least]
            of = [None, *words[often].view(np.int64).tolist(), *context[within][many].view(np.int64).tolist()]
            word = [None] * (1 + int(often.sum())) + h[within][many].view(np.int64).tolist()
            n = [len(h), *counts[often].tolist(), *dishes[dishes >= least].tolist()]
            yield pa.record_batch([pa.array(of, pa.int64()), pa.array(word, pa.int64()), pa.array(n, pa.int64())], names=["context", "word", "n"])

    return _releasing(run)


def _parts(word: np.ndarray, context: np.ndarray, split: Split, chunk: int, parts: int) -> np.ndarray:
    """The part of each token of a chunk; blocks of tokens, so that nothing but the result is as long as they are."""
    out = np.empty(len(word), np.uint32)
    for at in range(0, len(word), BLOCK_TOKENS):
        own = slice(at, at + BLOCK_TOKENS)
        key = _dish_keys(word[own], context[own])
        spread = np.where(_place(context[own], split.contexts) >= 0, key, _mixed(context[own]))
        hot = np.flatnonzero(_place(key, split.dishes) >= 0)
        spread[hot] = _mixed(key[hot] + np.array(chunk, np.uint64) * _STEP)
        out[own] = spread % np.uint64(parts)
    return out


def _dealt(split: Split, parts: int):
    """Occurrences by part, from chunks of documents: context, word, document and whether it trains; a chunk's ids go under -1 - chunk."""
    names = ["part", "chunk", "ids", "contexts", "at", "words", "word", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, base = 0, TaskContext.get().partitionId() << 20
        ids: list[int | None] = []
        train: list[bool] = []
        found: list[np.ndarray] = []
        held = 0

        def full() -> pa.RecordBatch:
            nonlocal made, ids, train, found, held
            chunk = base | made
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            word, found = np.concatenate(found), []
            context = _contexts(word, sizes)
            part = _parts(word, context, split, chunk, parts)
            order = np.lexsort([word, context, part])  # stable, so documents stay in order
            part = part[order]
            first = np.flatnonzero(_starts(part))
            occurring = part[first]
            del part
            doc = np.repeat((np.arange(len(sizes)) << 1 | np.array(train, np.int64)).astype(np.uint16), sizes)
            rows = [(-1 - chunk, chunk, _pack(np.array([NO_ID if x is None else x for x in ids], np.int64)), *[None] * 5)]
            for p, a, b in zip(occurring.tolist(), first, np.append(first[1:], len(order)), strict=True):
                o = order[a:b]
                contexts, at = np.unique(context[o], return_inverse=True)
                words, of = np.unique(word[o], return_inverse=True)
                steps = np.diff(at, prepend=0).astype(np.uint8)
                rows.append((p, chunk, None, _pack(contexts), _pack(steps), _pack(words), _pack(of.astype(np.uint32)), _pack(doc[o])))
            made += 1
            ids, train, found, held = [], [], [], 0
            columns = list(zip(*rows, strict=True))
            return pa.record_batch([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(columns)], names=names)

        for piece in (x for batch in batches for x in _pieces(batch, 1)):
            hashes = _hashed(piece.column(1).cast(pa.binary()).to_pylist())
            for doc_id, h, learns in zip(piece.column(0).to_pylist(), hashes, piece.column(2).to_pylist(), strict=True):
                ids.append(doc_id), train.append(bool(learns)), found.append(h)
                held += len(h)
                if held >= CHUNK_TOKENS or len(found) >= CHUNK_DOCS:
                    yield full()
        if found:
            yield full()

    return _releasing(run)


_DEALT = "part long, chunk long, ids binary, contexts binary, at binary, words binary, word binary, doc binary"
_STATE = "part long, words binary, contexts binary, dish_word binary, dish_context binary, dish_count binary, occurrences binary, rows binary, ids binary"


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and each one's place among them."""
    order = np.argsort(values)
    values = values[order]
    new = _starts(values)
    values = values[new]
    place = np.empty(len(order), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return values, place


def _joined(table: pa.Table) -> pa.Table:
    """One row for a part: its dishes with their training customers, and what to score: (row, dish) counts. Ids of a chunk pass as they are."""
    names = [c.split()[0] for c in _STATE.split(", ")]
    part = table.column("part")[0].as_py()
    if part < 0:
        return pa.table([pa.array([part], pa.int64()), *[pa.array([None], pa.binary())] * 7, pa.array([table.column("ids")[0].as_py()], pa.binary())], names=names)
    rows = table.select(["chunk", "contexts", "at", "words", "word", "doc"]).to_pylist()
    lists, before = ([_unpack(r[c], np.uint64) for r in rows] for c in ("words", "contexts"))
    words, contexts = np.unique(np.concatenate(lists)), np.unique(np.concatenate(before))
    docs = [_unpack(r["doc"], np.uint16) for r in rows]
    ends = np.cumsum([0, *map(len, docs)]).tolist()
    dish, train, row = np.empty(ends[-1], np.int64), np.empty(ends[-1], bool), np.empty(ends[-1], np.int64)
    for r, own, own_before, d, a, b in zip(rows, lists, before, docs, ends, ends[1:], strict=False):
        dish[a:b] = np.searchsorted(contexts, own_before)[np.cumsum(_unpack(r["at"], np.uint8), dtype=np.int64)]
        dish[a:b] *= len(words)
        dish[a:b] += np.searchsorted(words, own)[_unpack(r["word"], np.uint32)]
        train[a:b], row[a:b] = d & 1, d >> 1
        row[a:b] += r["chunk"] << 16
    del rows, lists, before, docs
    dishes, dish = _numbered(dish)
    count = np.bincount(dish[train], minlength=len(dishes))
    order = np.argsort(row, kind="stable")
    o_row, o_dish = row[order], dish[order]
    del row, dish, order
    # Within a row equal dishes stand together, as chunks are sorted by context and word.
    new = np.flatnonzero(_starts(o_row) | _starts(o_dish))
    times = np.diff(np.append(new, len(o_row)))
    o_row, o_dish = o_row[new], o_dish[new]
    first = np.flatnonzero(_starts(o_row))
    sizes = np.diff(np.append(first, len(new)))
    packed = [
        _pack(words),
        _pack(contexts),
        _pack((dishes % len(words)).astype(np.uint32)),
        _pack((dishes // len(words)).astype(np.uint32)),
        _pack(count.astype(np.uint32)),
        _bundle([_pack(x.astype(np.uint32)) for x in (sizes, o_dish, times)]),
        _pack(o_row[first]),
        None,
    ]
    return pa.table([pa.array([part], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=names)


def _bundle(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def _unbundle(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For arguments from 8 up, to ten digits."""
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y / 1260)) / x


@dataclass
class Seats:
    """Which customers of each dish opened tables: bits of `mask` for the first MASK, then (late_dish, late_at), sorted."""

    mask: np.ndarray
    late_dish: np.ndarray
    late_at: np.ndarray

    def tables(self) -> np.ndarray:
        return np.bitwise_count(self.mask).astype(np.int64) + np.bincount(self.late_dish, minlength=len(self.mask))

    def take(self, dishes: np.ndarray) -> Seats:
        place = np.full(len(self.mask), -1)
        place[dishes] = np.arange(len(dishes))
        own = place[self.late_dish] >= 0
        return Seats(self.mask[dishes], place[self.late_dish[own]], self.late_at[own])._sorted()

    def put(self, dishes: np.ndarray, new: Seats) -> None:
        self.mask[dishes] = new.mask
        gone = np.zeros(len(self.mask), bool)
        gone[dishes] = True
        kept = ~gone[self.late_dish]
        self.late_dish = np.concatenate([self.late_dish[kept], dishes[new.late_dish]])
        self.late_at = np.concatenate([self.late_at[kept], new.late_at])

    def _sorted(self) -> Seats:
        order = np.lexsort([self.late_at, self.late_dish])
        return Seats(self.mask, self.late_dish[order], self.late_at[order])

    def packed(self) -> bytes:
        return _bundle([_pack(self.mask), _pack(self.late_dish.astype(np.int64)), _pack(self.late_at.astype(np.int64))])

    @staticmethod
    def unpacked(raw: bytes) -> Seats:
        return Seats(*[_unpack(x, t).copy() for x, t in zip(_unbundle(raw), (np.uint32, np.int64, np.int64), strict=True)])

    @staticmethod
    def first(n: np.ndarray) -> Seats:
        return Seats(np.minimum(n, 1).astype(np.uint32), np.empty(0, np.int64), np.empty(0, np.int64))


Weight = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of these sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _before(opens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tables that each customer but a dish's first finds: one, and what those before have opened."""
    upto = np.cumsum(opens) - opens
    return 1 + upto - np.repeat(upto[np.cumsum(sizes) - sizes], sizes)


def _openings(rng: np.random.Generator, dish: np.ndarray, k: np.ndarray, sizes: np.ndarray, weight: Weight, discount: float) -> np.ndarray:
    """Which customers open a table, asked one after the other with a draw each.

    A customer's answer depends on the tables that it finds. All are asked at
    once, again and again with the tables that the last answers make, for as long
    as answers change: those are the answers of asking one after the other.
    """
    draw = rng.random(len(k))
    out = np.zeros(len(k), np.int64)
    at, opens = np.arange(len(k)), out.copy()
    while len(at):
        t = _before(opens, sizes)
        w = weight(dish, t)
        new = (draw * (k - discount * t + w) < w).astype(np.int64)
        out[at] = new
        starts = np.cumsum(sizes) - sizes
        open_still = np.logical_or.reduceat(new != opens, starts)
        opens = new
        if open_still.mean() < 0.7:
            keep = np.repeat(open_still, sizes)
            at, dish, k, draw, opens, sizes = at[keep], dish[keep], k[keep], draw[keep], opens[keep], sizes[open_still]
    return out


def seat(rng: np.random.Generator, n: np.ndarray, weight: Weight, discount: float, old: Seats | None = None) -> Seats:
    """The n customers of each dish, seated anew; weight(dishes, tables) is that of another table for dishes that have so many.

    Customer after customer opens a table by its weight against k - discount *
    tables of the k that sit already. The product of the normalising sums of all
    draws, new against old, is what a Metropolis test needs to give the openings
    the distribution in which no order of drawing shows.
    """
    out = Seats.first(n)
    total, total_old = np.zeros(len(n)), np.zeros(len(n))
    tables, tables_old = np.minimum(n, 1), np.minimum(n, 1)
    several = np.flatnonzero(n > 1)
    late: list[tuple[np.ndarray, np.ndarray]] = []
    # Blocks of dishes, so that arrays stay small.
    block = np.cumsum(np.minimum(n[several], EXACT)) // BLOCK_CUSTOMERS
    for dishes in np.split(several, np.flatnonzero(np.diff(block)) + 1) if len(several) else []:
        sizes = np.minimum(n[dishes], EXACT) - 1
        dish, k = np.repeat(dishes, sizes), _runs(sizes) + 1
        starts = np.cumsum(sizes) - sizes
        paths = [(_openings(rng, dish, k, sizes, weight, discount), total, tables)]
        if old is not None:
            opened = (k < MASK) & (old.mask[dish] >> np.minimum(k, MASK - 1).astype(np.uint32) & np.uint32(1)).astype(bool)
            place = np.full(len(n), -1)
            place[dishes] = starts
            own = (place[old.late_dish] >= 0) & (old.late_at < EXACT)
            opened[place[old.late_dish[own]] + old.late_at[own] - 1] = True
            paths.append((opened.astype(np.int64), total_old, tables_old))
        for opens, sums, count in paths:
            t = _before(opens, sizes)
            sums[dishes] = np.add.reduceat(np.log(k - discount * t + weight(dish, t)), starts)
            count[dishes] = 1 + np.add.reduceat(opens, starts)
        new = np.flatnonzero(paths[0][0])
        early = new[k[new] < MASK]
        np.bitwise_or.at(out.mask, dish[early], np.uint32(1) << k[early].astype(np.uint32))
        later = new[k[new] >= MASK]
        late.append((dish[later], k[later]))
    late += _jumps(rng, n, weight, discount, tables, total)
    if late:
        out = Seats(out.mask, *[np.concatenate(x).astype(np.int64) for x in zip(*late, strict=True)])._sorted()
    if old is None:
        return out
    total_old += _late_total(n, weight, discount, old, tables_old)
    accepted = np.log(rng.random(len(n))) < total - total_old
    new, kept = accepted[out.late_dish], ~accepted[old.late_dish]
    both = [np.concatenate([x[new], y[kept]]) for x, y in ((out.late_dish, old.late_dish), (out.late_at, old.late_at))]
    return Seats(np.where(accepted, out.mask, old.mask), *both)._sorted()


def _jumps(rng: np.random.Generator, n: np.ndarray, weight: Weight, discount: float, tables: np.ndarray, total: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Openings past the first EXACT customers, from one to the next; adds to the dishes' tables and totals."""
    active = np.flatnonzero(n > EXACT)
    start = np.full(len(active), EXACT, np.int64)
    found = []
    while len(active):
        t = tables[active]
        w, shift = weight(active, t), discount * t

        def stays(upto: np.ndarray, w=w, shift=shift) -> np.ndarray:
            return _log_gamma(upto - shift) - _log_gamma(upto - shift + w)

        # The chance that no customer up to a place opens a table falls below the draw where one does.
        draw = np.log(rng.random(len(active))) + stays(start)
        low, high = start.copy(), n[active].copy()
        opens = stays(high) < draw
        while (searched := opens & (high - low > 1)).any():
            mid = (low + high) // 2
            past = stays(mid) < draw
            high, low = np.where(searched & past, mid, high), np.where(searched & ~past, mid, low)
        total[active] += _log_gamma(high - shift + w) - _log_gamma(start - shift + w)
        found.append((active[opens], high[opens] - 1))
        tables[active[opens]] += 1
        left = opens & (high < n[active])
        active, start = active[left], high[left]
    return found


def _late_total(n: np.ndarray, weight: Weight, discount: float, seats: Seats, tables: np.ndarray) -> np.ndarray:
    """The sum of the logarithms of the normalising sums past the first EXACT customers, who have opened `tables`."""
    many, late = np.flatnonzero(n > EXACT), seats.late_at >= EXACT
    dish = np.concatenate([seats.late_dish[late], many])
    if not len(dish):
        return np.zeros(len(n))
    end = np.concatenate([seats.late_at[late] + 1, n[many]])
    order = np.lexsort([np.repeat([0, 1], [late.sum(), len(many)]), end, dish])
    dish, end = dish[order], end[order]
    within = _runs(np.unique(dish, return_counts=True)[1])
    start = np.where(within == 0, EXACT, np.concatenate([[0], end[:-1]]))
    t = tables[dish] + within
    w = weight(dish, t)
    return np.bincount(dish, _log_gamma(end - discount * t + w) - _log_gamma(start - discount * t + w), len(n))


@dataclass
class Root:
    """What a part knows of the root: customers and tables of its words, and the totals."""

    count: np.ndarray
    tables: np.ndarray
    all_count: float
    all_tables: float
    vocabulary: float

    def probability(self) -> np.ndarray:
        """The root's predictive probability of each word; all words, and one unknown, are alike to the base."""
        return (self.count - ROOT_DISCOUNT * self.tables + (ROOT_STRENGTH + ROOT_DISCOUNT * self.all_tables) / (self.vocabulary + 1)) / (ROOT_STRENGTH + self.all_count)

    def weight(self, word: np.ndarray, own: np.ndarray, rest: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """For dishes of these words that put `own` customers here, which are taken out: the weight of another table in a restaurant with `rest` tables of other dishes."""
        count = np.maximum(self.count[word] - own, 0)
        tables = np.maximum(np.minimum(self.tables[word], count), 1)
        base = (ROOT_STRENGTH + ROOT_DISCOUNT * (self.all_tables - self.tables[word] + tables)) / (self.vocabulary + 1)
        top, bottom = count - ROOT_DISCOUNT * tables + base, ROOT_STRENGTH + self.all_count - own
        return lambda i, t: (STRENGTH + DISCOUNT * (rest[i] + t)) * (top[i] + t) / (bottom[i] + t)


class _Part:
    """The restaurants of one part."""

    def __init__(self, row: dict, split: Split):
        self.part = int(row["part"])
        self.words, self.contexts = _unpack(row["words"], np.uint64), _unpack(row["contexts"], np.uint64)
        self.word, self.context, self.count = (_unpack(row[c], np.uint32).astype(np.int64) for c in ("dish_word", "dish_context", "dish_count"))
        # Places among the heavy contexts and dishes, or -1.
        self.heavy = _place(self.contexts, split.contexts)
        self.hot = _place(_dish_keys(self.words[self.word], self.contexts[self.context]), split.dishes)

    def own(self) -> np.ndarray:
        """Customers of each dish that is seated here."""
        return np.where(self.hot < 0, self.count, 0)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, values, len(self.words)).astype(np.int64)

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, len(self.contexts)).astype(np.int64)

    def sums(self, tables: np.ndarray, split: Split) -> bytes:
        """Customers and tables here of heavy contexts, and customers of heavy dishes: slots and values."""
        near, hot = np.flatnonzero(self.heavy >= 0), np.flatnonzero(self.hot >= 0)
        n, out = len(split.contexts), np.zeros(2 * len(split.contexts) + len(split.dishes), np.int64)
        np.add.at(out, self.heavy[near], self.per_context(self.count)[near])
        np.add.at(out, n + self.heavy[near], self.per_context(tables)[near])
        np.add.at(out, 2 * n + self.hot[hot], self.count[hot])
        slots = np.flatnonzero(out)
        return _bundle([_pack(slots), _pack(out[slots])])

    def reseat(self, seats: Seats | None, root: Root, shared: dict, sweep: int) -> Seats:
        rng = np.random.default_rng([SEED, sweep, self.part])
        n = self.own()
        before = seats
        seats = Seats.first(n) if seats is None else seats
        tables = seats.tables()
        here = self.per_context(tables)
        far = np.where(self.heavy >= 0, shared["context_tables"][self.heavy] - here, 0) if len(shared["context_tables"]) else np.zeros_like(here)
        several = np.flatnonzero(n > 1)
        rank = np.arange(len(several)) - np.searchsorted(self.context[several], self.context[several])
        for turn in range(TURNS):
            dishes = several[rank % TURNS == turn]
            if not len(dishes):
                continue
            own = tables[dishes]
            rest = (here + far)[self.context[dishes]] - own
            new = seat(rng, n[dishes], root.weight(self.word[dishes], own, rest), DISCOUNT, None if before is None else seats.take(dishes))
            seats.put(dishes, new)
            tables[dishes] = new.tables()
            here += self.per_context_of(dishes, tables[dishes] - own)
        return seats._sorted()

    def per_context_of(self, dishes: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context[dishes], values, len(self.contexts)).astype(np.int64)

    def predictive(self, tables: np.ndarray, root: Root, shared: dict) -> np.ndarray:
        """The probability of each dish's word in its context."""
        heavy, hot = self.heavy >= 0, self.hot >= 0
        n, t = self.per_context(self.count), self.per_context(tables)
        n[heavy], t[heavy] = shared["context_count"][self.heavy[heavy]], shared["context_tables"][self.heavy[heavy]]
        count, tables = self.count.copy(), tables.copy()
        count[hot], tables[hot] = shared["hot_count"][self.hot[hot]], shared["hot_tables"][self.hot[hot]]
        return (count - DISCOUNT * tables + (STRENGTH + DISCOUNT * t[self.context]) * root.probability()[self.word]) / (STRENGTH + n[self.context])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _summed(parts: DataFrame, slots: int) -> np.ndarray:
    """The sums over parts of their `sums`: three for each heavy context or dish at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at, values = (_unpack(y, np.int64) for y in _unbundle(x))
                total[at] += values
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "value"])

    out = np.zeros(slots, np.int64)
    if slots:
        for slot, value in parts.select("sums").mapInArrow(run, "slot long, value long").groupBy("slot").agg(F.sum("value")).collect():
            out[slot] = value
    return out


def _split(often: list) -> Split:
    """From rows (context, word), the word null for contexts; at most 1 / share of either."""
    contexts = np.sort(np.array([r[0] for r in often if r[1] is None], np.int64).view(np.uint64))
    pairs = [(r[0], r[1]) for r in often if r[1] is not None]
    context, word = (np.array([p[i] for p in pairs], np.int64).view(np.uint64) for i in (0, 1))
    keys = _dish_keys(word, context)
    order = np.argsort(keys)
    return Split(contexts, keys[order], np.searchsorted(contexts, context[order]), word[order])


_OWNED = "part long, range long, words binary, count binary, tables binary, seats binary, hot binary, all_count long, all_tables long, present long"
#: The part number under which a range keeps the root's seats.
_KEPT = -1


def _root(own: DataFrame, ranges: int, split: Split, shared: dict | None, before: DataFrame | None, sweep: int) -> DataFrame:
    """The root over parts: for rows (part, words, own) the sums by word, and the root's tables for them.

    Each range of hashes answers every part with the sums and tables of its
    words, and keeps its seats in a row of part _KEPT, with totals and what it
    knows of heavy dishes' words. Without `shared`, sums are tokens, not seated.
    """
    edges = np.array([i * (1 << 64) // ranges for i in range(ranges)], np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words, values = _unpack(row["words"], np.uint64), _unpack(row["own"], np.int64)
                bounds = np.append(np.searchsorted(words, edges), len(words)).tolist()
                cells = [(row["part"], i, _pack(words[a:b]), _pack(values[a:b]), None) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
                columns = list(zip(*cells, strict=True))
                yield pa.record_batch([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(columns)], names=["part", "range", "words", "own", "seats"])

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        kept = next((r["seats"] for r in rows if r["part"] == _KEPT), None)
        rows = [r for r in rows if r["part"] != _KEPT]
        lists = [_unpack(r["words"], np.uint64) for r in rows]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        count = np.bincount(at, np.concatenate([_unpack(r["own"], np.int64) for r in rows]), len(words)).astype(np.int64)
        spot = np.searchsorted(words, split.dish_word)
        here = np.flatnonzero((spot < len(words)) & (words[np.minimum(spot, len(words) - 1)] == split.dish_word)) if len(split.dish_word) else np.empty(0, np.int64)
        if shared is None:
            seats, tables = None, np.minimum(count, 1)
        else:
            np.add.at(count, spot[here], shared["hot_tables"][here])
            old = Seats.unpacked(kept) if kept else None
            own = old.tables() if old else np.minimum(count, 1)
            base = 1 / (shared["vocabulary"] + 1)
            rest = shared["root_tables"] - own
            rng = np.random.default_rng([SEED, sweep, rows[0]["range"], 1])
            # A word that has lost customers has lost openings beyond them.
            seats = seat(rng, count, lambda i, t: (ROOT_STRENGTH + ROOT_DISCOUNT * (rest[i] + t)) * base, ROOT_DISCOUNT, old and _within(old, count))
            tables = seats.tables()
        ends = np.cumsum([0, *map(len, lists)]).tolist()
        out = [(r["part"], r["range"], None, _pack(count[at[a:b]]), _pack(tables[at[a:b]]), None, None, None, None, None) for r, a, b in zip(rows, ends, ends[1:], strict=False)]
        hot = _bundle([_pack(here.astype(np.int64)), _pack(count[spot[here]]), _pack(tables[spot[here]])])
        out.append((_KEPT, rows[0]["range"], _pack(words), None, None, seats and seats.packed(), hot, int(count.sum()), int(tables.sum()), int((count > 0).sum())))
        names = [c.split() for c in _OWNED.split(", ")]
        return pa.table([pa.array(c, pa.binary() if kind == "binary" else pa.int64()) for c, (_, kind) in zip(zip(*out, strict=True), names, strict=True)], names=[n for n, _ in names])

    cells = own.mapInArrow(cut, "part long, range long, words binary, own binary, seats binary")
    if before is not None:
        cells = cells.unionByName(before.where(F.col("part") == _KEPT).select("part", "range", "words", F.lit(None).cast("binary").alias("own"), "seats"))
    return stage_table(cells.groupBy("range").applyInArrow(add, _OWNED), "root")


def _within(seats: Seats, n: np.ndarray) -> Seats:
    """The seats without what customers past the first n have opened; a word new to the root has opened one."""
    bits = (np.uint64(1) << np.minimum(n, MASK).astype(np.uint64)) - np.uint64(1)
    mask = seats.mask & bits.astype(np.uint32) | np.minimum(n, 1).astype(np.uint32)
    kept = seats.late_at < n[seats.late_dish]
    return Seats(mask, seats.late_dish[kept], seats.late_at[kept])


def _answers(owned: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(part, *names): the root's customers and tables of each part's words, from all ranges."""

    def gather(table: pa.Table) -> pa.Table:
        ordered = table.sort_by("range")
        packed = [_pack(np.concatenate([_unpack(x, np.int64) for x in ordered.column(c).to_pylist()])) for c in ("count", "tables")]
        return pa.table([table.column("part")[:1], *[pa.array([x], pa.binary()) for x in packed]], names=["part", *names])

    return owned.where(F.col("part") != _KEPT).select("part", "range", "count", "tables").groupBy("part").applyInArrow(gather, f"part long, {names[0]} binary, {names[1]} binary")


def _known(owned: DataFrame, split: Split) -> dict:
    """The root's totals, and its customers and tables of heavy dishes' words."""
    kept = owned.where(F.col("part") == _KEPT)
    count, tables, present = (int(x or 0) for x in kept.agg(F.sum("all_count"), F.sum("all_tables"), F.sum("present")).first())
    out = {"root_count": count, "root_tables": tables, "present": present, "hot_root": np.zeros((2, len(split.dishes)), np.int64)}
    if len(split.dishes):
        for (raw,) in kept.select("hot").collect():
            at, *values = (_unpack(x, np.int64) for x in _unbundle(raw))
            out["hot_root"][:, at] = values
    return out


def _added(table: pa.Table) -> pa.Table:
    """The sums of each document of a chunk over all parts, with its id."""
    ids = next(_unpack(x, np.int64) for x in table.column("ids").to_pylist() if x is not None)
    lists = [[_unpack(b, t) for b, t in zip(_unbundle(x), (np.uint16, np.uint32, np.uint32, float, float), strict=True)] for x in table.column("sums").to_pylist() if x is not None]
    row, *values = (np.concatenate(x) for x in zip(*lists, strict=True))
    n, known, base, own = (np.bincount(row, v, len(ids)) for v in values)
    return pa.table([pa.array(c) for c in (ids, n.astype(np.int64), known.astype(np.int64), base, own)], names=["id", "n", "known", "base", "own"])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", holdout: int = HOLDOUT, part_tokens: int = PART_TOKENS, burn_in: int = BURN_IN, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    learns = (remainder(id_col, holdout) != 0) & F.col(id_col).isNotNull()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), learns.alias("train"))
    size = texts.where("train").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six bytes make a token.
    share = max(part_tokens / 4 / max(1.0, size / 6), 1 / HEAVY)
    found = texts.where("train").select("text").mapInArrow(_heavy(share), "context long, word long, n long").groupBy("context", "word").agg(F.sum("n").alias("n"))
    found = stage_table(found, "heavy-candidates")
    total = (found.where("context is null").agg(F.sum("n")).first()[0]) or 0
    # A word of that share over all has it in some chunk; what is counted may miss chunks, never words.
    often = found.where(F.col("context").isNotNull() & (F.col("n") >= share * total)).select("context", "word").collect()
    contexts = {r[0] for r in often if r[1] is None}
    split = _split([r for r in often if r[0] in contexts])
    parts = int(max(8, -(-total // part_tokens)))

    def joined_part(table: pa.Table) -> pa.Table:
        out = _joined(table)
        _release()
        return out

    dealt = texts.mapInArrow(_dealt(split, parts), _DEALT)
    stored = stage_buckets(dealt.groupBy("part").applyInArrow(joined_part, _STATE), "restaurants", "part", min(parts, MOST_BUCKETS))
    state, ids = stored.where("part >= 0"), stored.where("part < 0").select((-1 - F.col("part")).alias("chunk"), "ids")
    model = state.select("part", "words", "contexts", "dish_word", "dish_context", "dish_count")
    n, h = len(split.contexts), len(split.dishes)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                part = _Part(row, split)
                packed = (row["words"], _pack(part.per_word(part.count)), part.sums(np.minimum(part.own(), 1), split))
                yield pa.record_batch([pa.array([part.part], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["part", "words", "own", "sums"])

    first = stage_table(model.mapInArrow(_releasing(started), "part long, words binary, own binary, sums binary"), "started")
    context_count, context_tables, hot_count = np.split(_summed(first, 2 * n + h), [n, 2 * n])
    tokens = _root(first.select("part", "words", "own"), parts, split, None, None, -1)
    shared = _known(tokens, split)
    shared |= {"tokens": shared["root_count"], "vocabulary": shared["present"], "context_count": context_count, "hot_count": hot_count, "hot_seats": Seats.first(hot_count), "hot_tables": np.minimum(hot_count, 1)}
    shared["context_tables"] = context_tables + np.bincount(split.dish_context, shared["hot_tables"], n).astype(np.int64)
    owned, seats = tokens, None
    used: list[tuple[DataFrame, DataFrame, dict]] = []
    for sweep in range(burn_in + sweeps):
        mark = staged_so_far()

        def reseated(batches: Iterator[pa.RecordBatch], shared=shared, sweep=sweep) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in _rows(batch):
                    part = _Part(row, split)
                    old = Seats.unpacked(row["seats"]) if sweep else None
                    new = part.reseat(old, _root_of(row, "root_n", "root_t", shared), shared, sweep)
                    tables = new.tables()
                    packed = (row["words"], _pack(part.per_word(tables)), new.packed(), part.sums(tables, split))
                    yield pa.record_batch([pa.array([part.part], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["part", "words", "own", "seats", "sums"])

        rows = model.join(_answers(owned, ("root_n", "root_t")), "part")
        if seats is not None:
            rows = rows.join(seats, "part")
        new = stage_table(rows.mapInArrow(_releasing(reseated), "part long, words binary, own binary, seats binary, sums binary"), f"sweep{sweep}")
        hot_seats, hot_tables = _hot(split, shared, sweep)
        shared = shared | {"hot_seats": hot_seats, "hot_tables": hot_tables}
        shared["context_tables"] = np.split(_summed(new, 2 * n + h), [n, 2 * n])[1] + np.bincount(split.dish_context, hot_tables, n).astype(np.int64)
        owned = _root(new.select("part", "words", "own"), parts, split, shared, owned if sweep else None, sweep)
        shared = shared | _known(owned, split)
        seats = new.select("part", "seats")
        if sweep >= burn_in:
            used.append((seats, owned, shared))
        if 0 < sweep <= burn_in:
            drop_staged(spark, *spent)
        spent = (mark, staged_so_far())

    joined = state.join(_answers(tokens, ("tokens", "ones")).drop("ones"), "part")
    for i, (seats, owned, _) in enumerate(used):
        joined = joined.join(seats.withColumnRenamed("seats", f"seats{i}"), "part").join(_answers(owned, (f"root_n{i}", f"root_t{i}")), "part")
    samples = [x[2] for x in used]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                part = _Part(row, split)
                p = sum(part.predictive(Seats.unpacked(row[f"seats{i}"]).tables(), _root_of(row, f"root_n{i}", f"root_t{i}", v), v) for i, v in enumerate(samples)) / len(samples)
                c = _unpack(row["tokens"], np.int64)
                base = np.log10((c + 0.1) / (samples[0]["tokens"] + 0.1 * (samples[0]["vocabulary"] + 1)))
                sizes, dish, times = (_unpack(b, np.uint32) for b in _unbundle(row["occurrences"]))
                of = np.repeat(np.arange(len(sizes)), sizes)
                known, seen, own = (np.bincount(of, x[dish] * times, len(sizes)) for x in ((c > 0)[part.word], base[part.word], np.log10(p)))
                keys = _unpack(row["rows"], np.int64)
                columns = [(keys & 0xFFFF).astype(np.uint16), np.bincount(of, times, len(sizes)).astype(np.uint32), known.astype(np.uint32), seen, own]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] >> 16 != keys[:-1] >> 16]))
                packed = [_bundle([_pack(c[a:b]) for c in columns]) for a, b in zip(first, np.append(first[1:], len(keys)), strict=True)]
                yield pa.record_batch([pa.array(keys[first] >> 16, pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "sums"])

    # One row for each part and chunk, and the chunk's ids; the chunks add up their documents.
    sums = joined.mapInArrow(_releasing(scored), "chunk long, sums binary").select("chunk", "sums", F.lit(None).cast("binary").alias("ids"))
    sums = sums.unionByName(ids.select("chunk", F.lit(None).cast("binary").alias("sums"), "ids"))
    sums = sums.groupBy("chunk").applyInArrow(_added, "id long, n long, known long, base double, own double")
    sums = sums.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    held_out, tokens_seen = remainder("doc_id", holdout) == 0, F.lit(int(shared["tokens"])).cast("long")
    return sums.select("doc_id", held_out.alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), tokens_seen.alias("train_tokens"), F.col("base").alias("base_score"), F.col("own").alias("score"))


def _root_of(row: dict, count: str, tables: str, shared: dict) -> Root:
    return Root(_unpack(row[count], np.int64), _unpack(row[tables], np.int64), shared["root_count"], shared["root_tables"], shared["vocabulary"])


def _hot(split: Split, shared: dict, sweep: int) -> tuple[Seats, np.ndarray]:
    """Heavy dishes, of which there are at most HEAVY, seated by the driver one after the other."""
    seats, context_tables = shared["hot_seats"], shared["context_tables"].copy()
    count, tables = shared["hot_root"]
    root = Root(count, tables, shared["root_count"], shared["root_tables"], shared["vocabulary"])
    out, own = Seats.first(shared["hot_count"]), seats.tables()
    rng = np.random.default_rng([SEED, sweep])
    for i in range(len(split.dishes)):
        one, of = np.array([i]), split.dish_context[i]
        rest = np.array([context_tables[of] - own[i]])
        new = seat(rng, shared["hot_count"][one], root.weight(one, own[one], rest), DISCOUNT, seats.take(one) if sweep else None)
        out.put(one, new)
        context_tables[of] += int(new.tables()[0]) - own[i]
    out = out._sorted()
    return out, out.tables()
