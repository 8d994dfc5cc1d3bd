"""Canonical exact fingerprints: Unicode normalisation, case and white-space folding, then a wide xxhash digest.

Rows are grouped by digest; inside a digest that several rows share, the
canonical bytes are compared, so a group never holds two different texts. The
comparison is an aggregate (how many distinct canonical texts a digest has)
whose partial results collapse a hot group of copies in every task.

Normalisation (NFKC) and full case folding are those of the ICU library that
Spark itself ships for its collations, called by the SQL function `reflect`; texts
of ASCII only are lower-cased. Tests hold both against Python's Unicode data for
every assigned code point.

Defined cases: a null text counts as empty; a null id orders before all others;
repeated rows are documents of their own in (doc_id, text hash) order; the only
document is its own next one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm.tables import BROADCAST_IDS, let, restrict, stage_table

LANES = 4
#: Documents in one range of ids when neighbours are looked up.
RANGE_ROWS = 1024
#: Ranges are cut in two steps of at most so many each, which bounds what is collected and broadcast; past their product ranges grow.
MOST_CUTS = 1024


def _icu(kind: str, method: str, text: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """NFKC, full case folding, and runs of white space as one blank."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", text))
    # Normalisation turns other white space into blanks, but for these.
    folded = F.translate(folded, "\x85\u1680\u2028\u2029", "    ")
    text = F.when(ascii_only, F.lower(text)).otherwise(folded)
    # Single blanks, by far the most common, match neither branch.
    return F.trim(F.regexp_replace(text, r" *[\t-\r][ \t-\r]*| {2,}", " "))


def digest(canon: Column, lanes: int = LANES) -> Column:
    """`lanes` hashes of 64 bits under different seeds, in hex."""
    return let(canon, lambda c: F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(i), c)), 16, "0") for i in range(lanes)])))


def exact_groups(docs: DataFrame, digests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", canon=canonical, make_digest=digest) -> DataFrame:
    """(digest, doc_id, same_id) for all rows of digests (doc_id, digest): same_id is the smallest id with the same canonical bytes.

    Texts are read again only where several documents share a digest.
    """
    shared = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    shared = stage_table(shared.where("n > 1").select("digest", "first_id"), "shared-digests")
    members = stage_table(digests.join(shared, "digest").select("digest", "doc_id").distinct(), "sharing-ids")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Grouping by the bytes themselves is the comparison; the tasks' partial groups hold one row for all copies.
    few = restrict(texts, members.select("doc_id").distinct(), "doc_id").select("doc_id", canon(F.col("text")).alias("canon"))
    few = few.withColumn("digest", make_digest(F.col("canon")))
    exact = few.groupBy("digest", "canon").agg(F.min("doc_id").alias("exact_id"))
    mixed = stage_table(exact.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "mixed-digests")
    plain = digests.join(shared, "digest", "left").select("digest", "doc_id", F.coalesce("first_id", "doc_id").alias("same_id"))
    if not mixed.limit(1).count():
        return plain
    apart = few.join(mixed, "digest", "left_semi").join(exact, ["digest", "canon"]).select("digest", "doc_id", F.col("exact_id").alias("same_id"))
    return plain.join(mixed, "digest", "left_anti").unionByName(apart)


def _cut(value: Column, bounds: Column) -> Column:
    """The place of a value among sorted distinct bounds; a value equal to one has a place of its own, so that a repeated id stands alone."""
    below = F.size(F.filter(bounds, lambda b: b <= value))
    return 2 * below - F.coalesce(F.get(bounds, below - 1) == value, F.lit(False)).cast("int")


def _steps(rows: int) -> int:
    return int(min(MOST_CUTS, max(1, math.ceil(math.sqrt(rows / RANGE_ROWS)))))


def _cuts(n: int) -> Column:
    """Sorted distinct bounds that cut doc_id into n parts of about equal counts, as an aggregate."""
    if n < 2:
        return F.array().cast("array<bigint>")
    return F.array_distinct(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n))


def _parted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with part, ascending by (doc_id, h), and h, the text's hash.

    Ids are cut at counted bounds, first over all, then inside each range; an id
    that repeats, or a missing one, is cut by the hash of its texts, which orders
    rows of one id; only rows equal in both stay in one part however many they are.
    """
    n = docs.count()
    steps = _steps(n)
    first = docs.select(_cuts(steps).alias("b")).first()[0] if steps > 1 and n else None
    top = F.lit(0) if not first else F.coalesce(_cut(F.col("doc_id"), F.lit(list(first)).cast("array<bigint>")), F.lit(-1))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.when(F.col("doc_id").isNull(), -1).otherwise(top).cast("long").alias("top"))
    inner = stage_table(rows.groupBy("top").agg(_cuts(steps).alias("bounds")), "id-bounds")
    rows = rows.join(F.broadcast(inner), "top")
    low = F.when(F.col("doc_id").isNull(), 0).otherwise(_cut(F.col("doc_id"), F.col("bounds"))).cast("long")
    rows = rows.select("doc_id", "text", "h", (F.col("top") * (1 << 11) + low).alias("range"))
    # Only a range of one id can be cut by hashes and stay in order.
    crowded = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where(f"n > {4 * RANGE_ROWS} and a <=> b")
    pieces = F.least(F.ceil(F.col("n") / RANGE_ROWS), F.lit(1 << 20))
    crowded = stage_table(crowded.select("range", pieces.alias("pieces")), "crowded")
    rows = rows.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded, "range", "left")
    piece = F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.coalesce("pieces", F.lit(1)))
    return rows.select("doc_id", "text", "h", (F.col("range") * (1 << 21) + piece).cast("long").alias("part"))


def _following(firsts: DataFrame) -> DataFrame:
    """(part, next_part) of the parts that hold rows; the last one's is null. No window spans all parts."""
    parts = firsts.select("part", F.shiftright("part", 32).alias("block"))
    blocks = parts.groupBy("block").agg(F.min("part").alias("block_first"))
    blocks = blocks.select("block", F.lead("block_first").over(Window.orderBy("block")).alias("after"))
    inside = F.lead("part").over(Window.partitionBy("block").orderBy("part"))
    return parts.withColumn("inner", inside).join(blocks, "block").select("part", F.coalesce("inner", "after").alias("next_part"))


def with_next(docs: DataFrame, derived: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, derived columns, and next_<column> of each: the value in the next row by ascending doc_id; after the last, the first.

    Rows are cut into ranges of about RANGE_ROWS rows; each range gets a copy of
    the first row of the following one, so that no window spans the table.
    Derived columns are computed once for each row and copy.
    """
    columns = ["text", *(derived or {})]
    dealt = _parted(docs.select("doc_id", "text"))
    # The hash is in the key as repeated ids need an order that every run agrees on.
    dealt = dealt.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "h"))
    firsts = stage_table(dealt.groupBy("part").agg(F.min("key").alias("key")), "firsts")
    order, lowest = _following(firsts), firsts.agg(F.min("part")).first()[0]
    order = order.select("part", F.coalesce("next_part", F.lit(lowest)).alias("from_part"))
    border = order.join(firsts.withColumnRenamed("part", "from_part"), "from_part")
    border = stage_table(border.select(F.col("part").alias("to_part"), F.col("key.doc_id").alias("first_id"), F.col("key.h").alias("first_h")), "borders")
    side = F.broadcast(border) if firsts.count() <= BROADCAST_IDS else border
    copies = dealt.join(side, dealt["doc_id"].eqNullSafe(side["first_id"]) & (dealt["h"] == side["first_h"]))
    copies = copies.select("doc_id", "text", F.col("to_part").alias("part"), "key", F.lit(True).alias("copy")).dropDuplicates(["part"])
    every = dealt.select("doc_id", "text", "part", "key", F.lit(False).alias("copy")).unionByName(copies).withColumns(derived or {})
    w = Window.partitionBy("part").orderBy("copy", "key")
    return every.select("doc_id", *columns, "copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("not copy").drop("copy")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half comes from the next document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base, {"fingerprint": digest(canonical(F.col("text")), lanes)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_fingerprint", digest(canonical(F.col("edited")), lanes))

    def likeness(other: str, other_fingerprint: str) -> Column:
        same = F.col("fingerprint") == F.col(other_fingerprint)
        return F.when(same, (canonical(F.col("text")) == canonical(F.col(other))).cast("double")).otherwise(F.lit(0.0))

    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("edited", "edited_fingerprint").alias("near_edited"), likeness("next_text", "next_fingerprint").alias("near_next"))
    return stage_table(rows, "fingerprints")
