"""Quality rules as a learned decision list.

Sequential covering grows conjunctions of thresholds on document statistics
that single out documents labelled as bad, prunes each on rows held out for
that, and removes what it covers before the next. The result is an ordered list
of readable rules, applied as one conditional expression.

The form of the list is bounded by parameters: at most MAX_RULES rules of
MAX_CONDITIONS conditions, thresholds between BINS quantiles of all labelled
rows. A rule needs MIN_SUPPORT bad rows, and MIN_PRECISION on the rows held out.
So a kind of bad document that is rarer than one labelled row in BINS is told
apart only where a single threshold above the last quantile parts it from the rest.

All steps are DataFrame operations. What reaches the driver is a histogram of
BINS bins a statistic for each condition grown: its size does not depend on the
number of rows. Statistics are computed once for each document, inside the row.

Defined cases: a null text has no words and fails the base rules; an empty
table gives an empty result; without labels the list is empty and keeps all
that pass the base rules; repeated rows are judged alike; a document labelled
twice counts twice; other columns are ignored or, in `reject`, carried along.
Repeated 3-word windows are found by 64-bit hashes inside one text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import WORD, let, remainder, stage_table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
BINS = 64
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_SUPPORT = 5
MIN_PRECISION = 0.8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = [*BASE, "n_lines", "n_upper", "n_bang"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _repeats(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more."""

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]))
            at = F.sort_array(F.filter(same, lambda p: p.isNotNull()))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, covered))

    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, F.lit(0)).otherwise(let(windows, counted))


def statistics(text: Column) -> Column:
    """One struct of the STATS of a text, all long."""
    text = F.coalesce(text, F.lit(""))

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
        kept = t
        for s in SYMBOLS:
            kept = F.replace(kept, F.lit(s))

        def of_words(w: Column) -> Column:
            return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words"))

        def of_lines(x: Column) -> Column:
            return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

        return F.struct(
            let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            (F.char_length(t) - F.char_length(kept)).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            (F.char_length(t) - F.char_length(F.replace(t, F.lit("!")))).cast("long").alias("n_bang"),
        )

    return let(text, of_text)


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs and `__stats`, a struct of STATS."""
    rows = docs.select(*[F.col(c) for c in (keep if keep is not None else docs.columns)], statistics(F.col(text_col)).alias("__s"))
    s = F.col("__s")
    flat = F.struct(*[(s["w"][c] if c in ("n_words", "word_chars", "n_repeat_words") else s["l"][c] if c in ("n_lines", "n_dup_lines") else s[c]).alias(c) for c in STATS])
    return rows.withColumn("__stats", flat).drop("__s")


def features(stats: str = "__stats") -> dict[str, Column]:
    """What the conditions are about: rates, so that a threshold means the same for short and long texts."""
    s = F.col(stats)
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return {
        "symbols_per_word": s["n_symbols"] / words,
        "bangs_per_word": s["n_bang"] / words,
        "upper_share": s["n_upper"] / chars,
        "repeat_share": s["n_repeat_words"] / words,
        "dup_line_share": s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1)),
        "chars_per_word": s["word_chars"] / words,
        "words_per_line": s["n_words"] / F.greatest(s["n_lines"], F.lit(1)),
    }


def base_failed(stats: str = "__stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """FOIL's gain of narrowing p0 bad and n0 good rows to p1 and n1."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _bin(name: str, cuts: list[float]) -> Column:
    """How many of the cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: F.col(name) > x))


def learn(labelled: DataFrame, names: list[str], *, max_rules: int = MAX_RULES) -> list[list[Condition]]:
    """Rules that single out rows with bad = 1, from rows (doc_id, bad, names...), bad being 0 or 1."""
    probabilities = [i / BINS for i in range(BINS + 1)]
    cuts_of = labelled.agg(*[F.percentile_approx(c, probabilities, 10_000).alias(c) for c in names]).first()
    seen = {c: sorted({float(x) for x in cuts_of[c] or []}) for c in names}
    # Thresholds stand half-way between values, so that none hugs what good rows happen to have.
    cuts = {c: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for c, v in seen.items()}
    names = [c for c in names if cuts[c]]
    if not names:
        return []
    rows = stage_table(
        labelled.select("bad", (remainder("doc_id", 97) % 3 == 0).alias("pruning"), *[_bin(c, cuts[c]).alias(c) for c in names]),
        "labelled-bins",
    )

    def meets(conditions: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for c, above, b in conditions:
            out = out & (F.col(c) > b if above else F.col(c) <= b)
        return out

    rules: list[list[tuple[str, bool, int]]] = []
    left = rows
    while len(rules) < max_rules:
        grown: list[tuple[str, bool, int]] = []
        while len(grown) < MAX_CONDITIONS:
            inside = left.where(~F.col("pruning") & meets(grown))
            bins = inside.select("bad", F.posexplode(F.array(*map(F.col, names)))).groupBy("pos", "col").agg(F.sum("bad"), F.sum(1 - F.col("bad")))
            counts = {c: {} for c in names}
            for pos, b, bad, good in bins.collect():  # at most BINS rows a statistic
                counts[names[pos]][b] = (bad, good)
            p0 = sum(x[0] for x in counts[names[0]].values())
            n0 = sum(x[1] for x in counts[names[0]].values())
            if p0 < MIN_SUPPORT or n0 == 0:
                break
            best, found = 1e-9, None
            for c in names:
                p = n = 0
                for b in range(len(cuts[c])):
                    p, n = p + counts[c].get(b, (0, 0))[0], n + counts[c].get(b, (0, 0))[1]
                    for above, (p1, n1) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if p1 >= MIN_SUPPORT and n1 < n0 and (g := _gain(p0, n0, p1, n1)) > best:
                            best, found = g, (c, above, b)
            if found is None:
                break
            grown.append(found)
        if not grown:
            break
        held = left.where("pruning").agg(*[F.coalesce(F.sum(F.when(meets(grown[:k]), v)), F.lit(0)) for k in range(1, len(grown) + 1) for v in (F.col("bad"), 1 - F.col("bad"))]).first()
        worth = [((held[2 * k] - held[2 * k + 1]) / max(1, held[2 * k] + held[2 * k + 1]), held[2 * k] / max(1, held[2 * k] + held[2 * k + 1]), -k) for k in range(len(grown))]
        value, precision, k = max(worth)
        if precision < MIN_PRECISION:
            break
        rules.append(grown[: 1 - k])
        left = left.where(~meets(rules[-1]))
    return [[Condition(c, above, cuts[c][b]) for c, above, b in rule] for rule in rules]


def keep_expression(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """The list as ordered conditions: whether a row is kept, and the number of the rule that rejects it (else null)."""
    kept, by = F.lit(True), F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        fits = F.lit(True)
        for c in rule:
            fits = fits & c.column()
        kept, by = F.when(fits, F.lit(False)).otherwise(kept), F.when(fits, F.lit(i)).otherwise(by)
    return kept, by


def fit(stats: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", holdout: int = 5) -> list[list[Condition]]:
    """Learn from the labelled rows outside the held-out fold; base failures need no rule."""
    own = features()
    rows = stats.where(~base_failed()).select(F.col(id_col).alias("doc_id"), *[v.cast("double").alias(k) for k, v in own.items()])
    bad = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (1 - F.col(label_col).cast("int")).alias("bad"))
    labelled = rows.join(bad, "doc_id").where(remainder("doc_id", holdout) != 0)
    return learn(stage_table(labelled, "labelled"), list(own))


def judge(stats: DataFrame, rules: list[list[Condition]], keep: list[str]) -> DataFrame:
    """The kept columns, STATS, base_failed, kept and the number of the rejecting rule."""
    own = features()
    kept, by = keep_expression(rules)
    rows = stats.select(*keep, "__stats", *[v.cast("double").alias(k) for k, v in own.items()])
    return rows.select(*keep, *[F.col("__stats")[c].alias(c) for c in STATS], base_failed().alias("base_failed"), F.when(base_failed(), F.lit(False)).otherwise(kept).alias("kept"), F.when(~base_failed(), by).alias("rule"))


def reject(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns; texts are not shuffled."""
    stats = stage_table(with_statistics(docs, text_col), "documents-with-statistics")
    rules = fit(stats.select(id_col, "__stats"), labels, id_col=id_col)
    own = features()
    kept, _ = keep_expression(rules)
    names = {k: f"__f_{k}" for k in own}
    rows = stats.withColumns({names[k]: v.cast("double") for k, v in own.items()})
    fits = F.lit(True)
    for rule in rules:
        hit = F.lit(True)
        for c in rule:
            hit = hit & Condition(names[c.feature], c.above, c.threshold).column()
        fits = fits & ~hit
    return rows.where(~base_failed() & fits).select(*docs.columns)
