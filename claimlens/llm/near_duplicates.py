"""MinHash near-duplicates: banded candidates, checked by odd sketches, confirmed on full shingle sets.

Documents with equal shingle sets form one class, a node of the graph of links.
Each class has MinHash samples: groups of them are the bands that name buckets,
and all are folded into a bitmap of parities (an odd sketch). The population
count of the XOR of two sketches estimates a high similarity closely, so few
pairs need their full sets.

No step pairs all members of a bucket. First, in some of the buckets, each member
meets the least node of its bucket; as nodes are numbered at random, a group of
near copies has the same one in most bands, so that a node has few links. Where
buckets then still hold several components with pairs that have not met, each
member meets a node that its bucket draws, if that is of another component. Where buckets hold several
components even so, their members meet inside the bucket on sketches alone, in
tiles of nodes of like size; only components with a pair of like sketches go on,
and form clusters. Nodes outside a cluster's largest component then meet the
others on full sets, in blocks, so that no link between components is lost to the
choice of centres; a block returns a spanning forest, never all of its links. All
links are confirmed on full sets. Links inside a component need no test, as they
change nothing. Pages that share a template, but too little to be linked, so cost
a sketch for each bucket, and never send a set.

Parameters give a pair of similarity 0.8 a chance of 8e-6 to share no bucket (one
of 0.85 1.4e-9), a pair of similarity 1/3 one of 1 % to share any, and a pair of 0.8
one of about 1e-6 to be dropped by the sketches (they pass five standard
deviations below the threshold).

Defined cases: a null or empty text has no shingles and is linked with nothing;
a text of fewer words than a shingle is one shingle; repeated rows share a
component and are kept together; an id with several texts stands in the component
of each; a row without id takes the component of an equal set, else none, and is
kept then; an empty table gives an empty result; other columns are ignored or, in
`drop_near_copies`, carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.bytewords import sliced
from claimlens.llm.components import components
from claimlens.llm.tables import BROADCAST_IDS, drop_staged, stage_table, staged_so_far

BANDS = 64
BAND_ROWS = 8
SAMPLES = 512
SKETCH_WORDS = 16
#: Nodes of a tile whose sketches meet, and words of a sketch above which it counts as several.
TILE_NODES = 8_192
TILE_WORDS = 128
#: Where shared buckets count, pairs of a bucket of so many nodes at most are listed instead of meeting in tiles.
SMALL_BUCKET = 32
#: Weight of a block of nodes whose full sets meet another block's: their shingles, and NODE_WEIGHT for each node.
BLOCK_WEIGHT = 100_000
NODE_WEIGHT = 100
#: Nodes (40 bytes each) that are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: The similarity from which documents are linked, in hundredths.
PERCENT = 80
#: Least similarity that a sketch has to show.
SKETCH_LEAST = 0.69
#: Whether sketches that differ in so many bits, of sets of such sizes, may be those of linked sets; for columns and arrays alike.
Close = Callable[[Any, Any, Any], Any]
#: How many buckets linked sets of sizes na >= nb share at least, those counted where either leads; for arrays.
Need = Callable[[Any, Any], Any]
_SEED = 7_919
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `width` words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(width, len(h))):
        out = _mixed(out * _STEP + h[k : k + n])
    return np.unique(out)


class _Samples:
    """MinHash samples by multiply-add on 32 bits, and the sketch of all samples."""

    def __init__(self):
        rng = np.random.default_rng(_SEED)
        self.a = (rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None]
        self.salt = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP)

    def of(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 1024):
            np.minimum(low, (x[None, k : k + 1024] * self.a + self.b).min(axis=1), out=low)
        return low

    def sketch(self, low: np.ndarray) -> np.ndarray:
        bits = (_mixed(low.astype(np.uint64) + self.salt) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
        odd = np.bincount(bits, minlength=64 * SKETCH_WORDS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def bands(self, low: np.ndarray) -> np.ndarray:
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in low[: BANDS * BAND_ROWS].astype(np.uint64).reshape(BANDS, BAND_ROWS).T:
            h = _mixed(h * _STEP + row)
        return h.view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = _Samples()
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                low = samples.of(s)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), samples.sketch(low), samples.bands(low)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "text_hash", "n", "set_hash", "sketch", "bands"])

    return run


def _sets(width: int):
    """Full sets of the nodes' own texts; an id may have other texts too, which have another hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in sliced(whole, 2)):
            found = [shingles(t, width) for t in batch.column(2).to_pylist()]
            own = np.array([xxhash.xxh3_128_digest(s.tobytes()) == h for s, h in zip(found, batch.column(1).to_pylist(), strict=True)], bool)
            nodes = batch.column(0).filter(pa.array(own))
            yield pa.record_batch([nodes, pa.array([s.view(np.int64) for s, x in zip(found, own, strict=True) if x], pa.list_(pa.int64()))], names=["node", "s"])

    return run


def _similar_size(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _sketch_odds() -> int:
    """The most bits in which two sketches differ at similarity SKETCH_LEAST."""
    n = 64 * SKETCH_WORDS
    return int(n / 2 * (1 - np.exp(-4 * SAMPLES * (1 - SKETCH_LEAST) / n)))


def _sketches_close(bits: Any, na: Any, nb: Any) -> Any:
    return bits <= _sketch_odds()


def _differing(a: str, b: str) -> Column:
    """Bits in which sketches differ; the longer one is folded to the other's length, which is half of its own."""

    def folded(x: str, other: str) -> str:
        return f"if(size({x}) > size({other}), zip_with(slice({x}, 1, size({other})), slice({x}, size({other}) + 1, size({other})), (p, q) -> p ^ q), {x})"

    return F.expr(f"aggregate(zip_with({folded(a, b)}, {folded(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")


class _Sketches:
    """The sketches of a column. Their lengths are powers of two; of two that differ in length the longer one is folded."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        bounds, flat = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64)
        self.words = np.diff(bounds)
        self.at = np.zeros(len(self.words), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for words in np.unique(self.words):
            own = np.flatnonzero(self.words == words)
            self.at[own] = np.arange(len(own))
            self.rows[int(words)] = flat[bounds[own][:, None] + np.arange(words)]

    def differing(self, i: int, near: np.ndarray) -> np.ndarray:
        """Bits in which sketch i differs from each of those near."""
        mine = self.rows[int(self.words[i])][self.at[i]][None]
        out = np.zeros(len(near), np.int64)
        for words in np.unique(self.words[near]):
            here = self.words[near] == words
            others = self.rows[int(words)][self.at[near[here]]]
            least = min(int(words), mine.shape[1])
            out[here] = np.bitwise_count(_folded(others, least) ^ _folded(mine, least)).sum(axis=1, dtype=np.int64)
        return out


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


#: The full sets (node, s) of the nodes of a table (node), staged.
Sets = Callable[[DataFrame], DataFrame]


def _like_pairs(pairs: DataFrame, classes: DataFrame, close: Close) -> DataFrame:
    """Of the pairs (a, b) of nodes those of like size and sketch."""
    names = pairs.columns
    for c in "ab":
        signed = classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        pairs = pairs.join(signed, c)
    return pairs.where(_similar_size("na", "nb")).where(close(_differing("sa", "sb"), F.col("na"), F.col("nb"))).select(*names)


def _linked(pairs: DataFrame, classes: DataFrame, sets: Sets, close: Close = _sketches_close) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose sizes and sketches, and then full shingle sets, are similar enough."""
    both = stage_table(_like_pairs(pairs, classes, close), "near-candidates")
    full = sets(both.select(F.col("a").alias("node")).unionByName(both.select(F.col("b").alias("node"))))
    for c in "ab":
        both = both.join(full.select(F.col("node").alias(c), F.col("s").alias(f"s{c}")), c)
    counted = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("inter"))
    return counted.where(100 * F.col("inter") >= PERCENT * (F.col("total") - F.col("inter"))).select("a", "b")


def _relabelled(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(id, component) after adding links; earlier components count as single nodes."""
    if labels is None:
        return components(links)
    a = links.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left")
    a = a.join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    roots = components(a.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    roots = stage_table(roots, "roots")
    moved = labels.join(roots.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left")
    known = moved.select("id", F.coalesce("root", "component").alias("component"))
    return stage_table(known.unionByName(roots.join(labels, "id", "left_anti")), "near-labels")


def _unsure(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Members (node, bucket, lead, tested, c, size of the bucket) of the buckets with pairs of several components c that have not met; None without any."""
    placed = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select("node", "bucket", "lead", "tested", F.coalesce("component", "node").alias("c"))
    rest = placed.where(~F.col("tested")).groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("lead").alias("led"), F.count("*").alias("size"))
    unsure = stage_table(placed.join(rest.where("low < high and led").select("bucket", "size"), "bucket"), "open-members")
    return unsure if unsure.limit(1).count() else None


def _tiles(unsure: DataFrame, classes: DataFrame) -> DataFrame:
    """The unsure members with their sketches, dealt to tiles in which all pairs of a bucket that need a test meet.

    A node stands in its bucket's tile of its own size band and visits the one
    below, as sets of linked nodes are like in size. Large tiles are cut in parts
    that meet two by two.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.0 / PERCENT + 1e-4))).cast("int")
    rows = unsure.join(classes.select("node", "n", "sketch"), "node").withColumn("band", band)
    stands = F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(False).alias("visits")), F.struct((F.col("band") - 1).alias("tile"), F.lit(True).alias("visits"))))
    rows = rows.withColumn("at", stands).select("bucket", "at.tile", "at.visits", "node", "c", "n", "lead", "sketch")
    sizes = rows.groupBy("bucket", "tile").agg(F.count("*").alias("size"), F.sum(F.greatest(F.lit(1.0), F.size("sketch") / TILE_WORDS)).alias("weight"), F.count(F.when(~F.col("visits"), 1)).alias("own")).where("own > 0 and size > 1")
    parts = F.ceil(F.col("weight") / TILE_NODES).cast("int")
    rows = rows.join(sizes.select("bucket", "tile", parts.alias("parts")), ["bucket", "tile"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    place = F.xxhash64("bucket", "tile", F.least("part", "other"), F.greatest("part", "other"))
    return rows.select(place.alias("place"), (F.col("part") == F.col("other")).alias("inside"), "part", "visits", "c", "n", "lead", "sketch")


def _alike(table: pa.Table, close: Close) -> tuple[list[int], list[int]]:
    """Of a tile: pairs of components that hold a pair of nodes of like size and sketch, as a forest."""
    label, of = np.unique(np.asarray(table.column("c")), return_inverse=True)
    if len(label) < 2:
        return [], []
    n, part = np.asarray(table.column("n")), np.asarray(table.column("part"))
    inside, visits, lead = (np.asarray(table.column(c)) for c in ("inside", "visits", "lead"))
    sketches = _Sketches(table.column("sketch"))
    a, b, root = [], [], of.copy()
    for i in np.flatnonzero(of != np.bincount(of).argmax()):
        near = np.flatnonzero((root != root[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])) & (lead | lead[i]) & ~(visits & visits[i]) & (inside[i] | (part != part[i])))
        near = near[close(sketches.differing(i, near), n[near], n[i])]
        for other in np.unique(root[near]):
            a.append(int(label[of[i]]))
            b.append(int(label[of[near[root[near] == other][0]]]))
            root[root == other] = root[i]
    return a, b


def _alike_in_runs(close: Close):
    """Tiles come sorted, so that a tile is a run of rows; only the last run of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        names = ["a", "b"]

        def pairs(table: pa.Table) -> pa.RecordBatch:
            place = np.asarray(table.column("place"))
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            a: list[int] = []
            b: list[int] = []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                found = _alike(table.slice(x, y - x), close) if y - x > 1 else ([], [])
                a += found[0]
                b += found[1]
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.asarray(batch.column(0))
            last = int(np.flatnonzero(place == place[-1])[0])
            if last or (waiting and waiting[-1].column(0)[-1].as_py() != place[0]):
                yield pairs(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield pairs(pa.Table.from_batches(waiting))

    return run


_PAIR = "a long, b long, ca long, cb long, need long"


def _pairs_within(need: Need):
    """Of members sorted by bucket all pairs inside a bucket of like size, of two components, of which one leads; a is the larger."""

    def pairs(of: list[np.ndarray]) -> pa.RecordBatch:
        bucket, node, c, n, lead = of
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, len(bucket)):
            i = np.flatnonzero(bucket[step:] == bucket[:-step])
            if not len(i):
                break
            j = i + step
            fits = (c[i] != c[j]) & (lead[i] | lead[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
            first.append(i[fits])
            second.append(j[fits])
        i, j = np.concatenate(first), np.concatenate(second)
        turned = (n[i] < n[j]) | ((n[i] == n[j]) & (node[i] < node[j]))
        a, b = np.where(turned, j, i), np.where(turned, i, j)
        return pa.record_batch([pa.array(x, pa.int64()) for x in (node[a], node[b], c[a], c[b], need(n[a], n[b]))], names=["a", "b", "ca", "cb", "need"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "node", "c", "n", "lead")]
            of = of if waiting is None else [np.concatenate(x) for x in zip(waiting, of, strict=True)]
            last = int(np.flatnonzero(of[0] != of[0][-1])[-1]) + 1 if of[0][0] != of[0][-1] else 0
            waiting = [x[last:] for x in of]
            if last:
                yield pairs([x[:last] for x in of])
        if waiting is not None:
            yield pairs(waiting)

    return run


def _counted_pairs(small: DataFrame, classes: DataFrame, need: Need) -> DataFrame:
    """(a, b, ca, cb): pairs of small buckets that share as many of them as linked sets must.

    A pair that also shares a large bucket, or one whose centre is one of the two,
    may count too few here; it meets there.
    """
    rows = small.where("not tested").join(classes.select("node", "n"), "node").select("bucket", "node", "c", "n", "lead")
    found = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_pairs_within(need), _PAIR)
    counted = found.groupBy("a", "b", "ca", "cb").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    return counted.where("met >= need").select("a", "b", "ca", "cb")


def _clusters(unsure: DataFrame, classes: DataFrame, close: Close, need: Need | None) -> DataFrame:
    """(c, cluster): components that hang together by pairs of a bucket whose sketches are alike."""
    large = unsure if need is None else unsure.where(F.col("size") > SMALL_BUCKET)
    tiles = _tiles(large, classes).repartition("place").sortWithinPartitions("place")
    alike = tiles.mapInArrow(_alike_in_runs(close), "a long, b long")
    if need is not None:
        few = _like_pairs(_counted_pairs(unsure.where(F.col("size") <= SMALL_BUCKET), classes, need), classes, close)
        alike = alike.unionByName(few.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    alike = stage_table(alike.distinct(), "alike")
    return components(alike).select(F.col("id").alias("c"), F.col("component").alias("cluster"))


def _crossing(percent: int, close: Close):
    """Between a block of outsiders and a block of nodes: links on full sets that join two components, never more than components."""

    def run(table: pa.Table) -> pa.Table:
        outside = np.asarray(table.column("outside"))
        ids, n = (np.asarray(table.column(c)) for c in ("node", "n"))
        of = np.unique(np.asarray(table.column("c")), return_inverse=True)[1]
        sketches = _Sketches(table.column("sketch"))
        sets = table.column("s").combine_chunks()
        bounds, values = np.asarray(sets.offsets), np.asarray(sets.values).view(np.uint64)
        rest = np.flatnonzero(~outside)
        a, b = [], []
        for i in np.flatnonzero(outside):
            near = rest[(of[rest] != of[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))]
            near = near[close(sketches.differing(i, near), n[near], n[i])]
            if not len(near):
                continue
            own = values[bounds[i] : bounds[i + 1]]
            lists = [values[bounds[k] : bounds[k + 1]] for k in near]
            joined = np.concatenate(lists)
            at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            shared = np.add.reduceat(own[at] == joined, np.cumsum([0, *map(len, lists[:-1])]), dtype=np.int64)
            linked = near[100 * shared >= percent * (n[near] + n[i] - shared)]
            others, first = np.unique(of[linked], return_index=True)
            a += [int(ids[i])] * len(others)
            b += ids[linked[first]].tolist()
            of[np.isin(of, others)] = of[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _left_between(unsure: DataFrame, classes: DataFrame, sets: Sets, close: Close = _sketches_close, need: Need | None = None) -> DataFrame:
    """Links that the centres did not tell, between components that share a bucket and have like sketches there.

    A cluster's largest component is the core; the others' nodes are outsiders,
    who meet the whole cluster on full sets, in blocks of BLOCK_WEIGHT on either
    side.
    """
    clusters = _clusters(unsure, classes, close, need)
    inside = unsure.select("node", "c").distinct().join(clusters, "c").join(classes.select("node", "n", "sketch"), "node")
    inside = stage_table(inside, "clusters")
    parts = inside.groupBy("cluster", "c").agg(F.sum(F.col("n") + NODE_WEIGHT).alias("n"))
    shape = parts.groupBy("cluster").agg(F.max_by("c", F.struct("n", "c")).alias("core"), F.sum("n").alias("all"), F.max("n").alias("most"))
    blocks = (F.ceil(F.col(x) / BLOCK_WEIGHT).cast("int") for x in ("all", "rest"))
    shape = shape.withColumn("rest", F.col("all") - F.col("most")).select("cluster", "core", *[F.greatest(b, F.lit(1)).alias(k) for k, b in zip(("rows", "columns"), blocks, strict=True)])
    known = inside.join(shape, "cluster").withColumn("draw", F.xxhash64("node"))

    def row(outside: bool) -> DataFrame:
        own, other = ("columns", "rows") if outside else ("rows", "columns")
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        fixed = F.pmod(F.col("draw"), F.col(own)).cast("int")
        x, y = (spread.alias("x"), fixed.alias("y")) if outside else (fixed.alias("x"), spread.alias("y"))
        out = known.where(F.col("c") != F.col("core")) if outside else known
        return out.select("cluster", "node", "c", "n", "sketch", F.lit(outside).alias("outside"), x, y)

    met = row(True).unionByName(row(False)).join(sets(inside.select("node")), "node")
    found = met.groupBy("cluster", "x", "y").applyInArrow(_crossing(PERCENT, close), "a long, b long")
    return stage_table(found, "near-late")


def _classes(rows: DataFrame) -> DataFrame:
    """One node for each shingle set: its smallest id, size, sketch and bands. Nodes are numbered in the order of a hash."""
    found = rows.where("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    # The table fixes the numbers: they are drawn once, when it is written.
    return stage_table(found.withColumn("node", F.monotonically_increasing_id()), "classes")


ROWS = "doc_id long, text_hash long, n long, set_hash binary, sketch array<long>, bands array<long>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _all_lead(classes: DataFrame) -> DataFrame:
    return classes.select("node", F.explode("bands").alias("bucket"), F.lit(True).alias("lead"))


#: Added to the nodes that do not lead in a bucket, so that those that do come first.
_FOLLOWS = 1 << 62


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, key) those of buckets with several nodes whose first one leads: it is the centre.

    Batches are passed through as they come; of the last bucket its first row is
    held back while it is the only one.
    """
    held = None  # bucket and key of the last bucket's first row, and whether it still waits
    for batch in batches:
        bucket, key = (np.asarray(batch.column(c)) for c in (0, 1))
        if not len(bucket):
            continue
        if held is not None and held[2]:
            bucket, key = np.append(np.int64(held[0]), bucket), np.append(np.int64(held[1]), key)
        first = np.append(True, bucket[1:] != bucket[:-1])
        goes_on = held is not None and not held[2] and held[0] == bucket[0]
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(bucket)))
        centre, several = key[at], length > 1
        if goes_on:
            centre[0], several[0] = held[1], True
        held = (int(bucket[-1]), int(centre[-1]), not several[-1])
        chosen = np.repeat(several & (centre < _FOLLOWS), length)
        node = key[chosen]
        yield pa.record_batch([pa.array(node & (_FOLLOWS - 1)), pa.array(bucket[chosen]), pa.array(node < _FOLLOWS), pa.array(np.repeat(centre, length)[chosen])], names=["node", "bucket", "lead", "centre"])


def labelled(texts: DataFrame, signed: DataFrame, width: int, members_of: Callable[[DataFrame], DataFrame] = _all_lead, close: Close = _sketches_close, star_part: int = 4, need: Need | None = None) -> DataFrame:
    """doc_id, text_hash, n, component and kept for every row.

    signed are the signed texts (ROWS). members_of gives (node, bucket, lead) of
    classes: two nodes may be linked if they share a bucket and one leads there.
    One in star_part buckets, drawn by their hashes, has a centre that all meet;
    the rest wait for the components of these. With need, pairs of small buckets
    go on only if they share enough of them. What is staged on the way is dropped
    as soon as nothing reads it.
    """
    spark = texts.sparkSession
    link = _linked if close is _sketches_close else partial(_linked, close=close)
    start = staged_so_far()
    signed = stage_table(signed, "signatures")
    classes = _classes(signed)
    rows = stage_table(signed.select("doc_id", "text_hash", "n", "set_hash"), "rows")
    drop_staged(spark, start, start + 1)
    # One shuffle of two numbers a member: most buckets have a single one, and end there.
    key = F.when(F.col("lead"), F.col("node")).otherwise(F.col("node") + F.lit(_FOLLOWS))
    dealt = members_of(classes.where("rep is not null")).select("bucket", key.alias("key")).repartition("bucket").sortWithinPartitions("bucket", "key")
    members = stage_table(dealt.mapInArrow(_shared, "node long, bucket long, lead boolean, centre long"), "bucket-members")

    def sets(nodes: DataFrame) -> DataFrame:
        chosen = stage_table(classes.join(nodes.distinct(), "node", "left_semi").select("node", "rep", "set_hash"), "open-nodes")
        chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_NODES else chosen
        found = texts.join(chosen, texts["doc_id"] == chosen["rep"]).select("node", "set_hash", "text")
        return stage_table(found.mapInArrow(_sets(width), "node long, s array<long>"), "near-sets")

    def joined(links: Callable[[], DataFrame], labels: DataFrame | None) -> DataFrame:
        start = staged_so_far()
        found = links()
        end = staged_so_far()
        labels = _relabelled(found, labels)
        drop_staged(spark, start, end)
        return labels

    # Groups of near copies hang together after a part of their buckets; the others then have little left to test.
    starred = F.pmod("bucket", F.lit(star_part)) == 0
    star = members.where(starred & (F.col("node") != F.col("centre"))).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    labels = joined(lambda: link(star, classes, sets), None)
    unsure = _unsure(members.withColumn("tested", starred & (F.col("node") == F.col("centre"))), labels)
    if unsure is not None:
        draws = unsure.where("lead and not tested")
        draws = draws if need is None else draws.where(F.col("size") > SMALL_BUCKET)
        drawn = draws.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("draw"), "node", "c")).alias("x")).select("bucket", F.col("x.node").alias("b"), F.col("x.c").alias("cb"))
        met = unsure.join(drawn, "bucket", "left")
        pairs = met.where("c <> cb").select(F.col("node").alias("a"), "b").distinct()
        labels = joined(lambda: link(pairs, classes, sets), labels)
        unsure = _unsure(met.select("node", "bucket", "lead", (F.col("tested") | F.coalesce(F.col("node") == F.col("b"), F.lit(False))).alias("tested")), labels)
    if unsure is not None:
        labels = joined(lambda: _left_between(unsure, classes, sets, close, need), labels)

    labels = labels.withColumnRenamed("id", "node").join(classes.select("node", "rep"), "node")
    least = labels.groupBy("component").agg(F.min("rep").alias("least"))
    labels = labels.join(least, "component").select("node", "least")
    known = classes.select("node", "set_hash", "rep").join(labels, "node", "left").select("set_hash", F.coalesce("least", "rep").alias("component"))
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return rows.join(known, "set_hash", "left").select("doc_id", "text_hash", "n", component.alias("component_id"), kept.alias("kept"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    texts = _texts(docs, id_col, text_col)
    return labelled(texts, texts.mapInArrow(_signatures(width), ROWS), width)


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest of its component) for every row."""
    return _labelled(docs, id_col, text_col, width).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns."""
    rows = _labelled(docs, id_col, text_col, width).where("not kept and doc_id is not null")
    gone = stage_table(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "near-copies")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, (docs[id_col] == side["__id"]) & (F.xxhash64(docs[text_col]) == side["__hash"]), "left_anti")
