"""URL filters: host and path rules indexed by their rarest literal token.

A rule is an action and `host/path`; it fits that host and its subdomains when
the url's path starts with the rule's path. Pattern rules (an action, a regular
expression and the literal tokens that any match holds) judge the urls that no
such rule fits. Each rule is filed under the one of its literal tokens that the
urls hold least often; a url's tokens look up their slot of the index, and only
the rules found there run their regular expressions. The longest fitting rule
wins; with none the url is allowed.

The index is one literal array of slots, so the operator is a projection: no
shuffle, no join, no row grows. The list of rules is a parameter of any length
that the driver holds; it travels as one text. A rule without a literal token, as
of a host in other letters, stands in a slot that every url reads.

Defined cases: a null url, or one without "://", has empty host and path and is
judged by the default; repeated rows get equal verdicts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for the token of rules that have none.
NO_TOKEN = ""
#: The rules of the contract.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Patterns over host and path for urls without a rule, with a token that every match holds.
PATTERNS = (
    ("block", r"^[^/]*/(?:.*/)?login(?:/|$)", ("login",)),
    ("block", r"^(?:.*\.)?casino\.", ("casino",)),
    ("block", r"^(?:.*\.)?ads\.", ("ads",)),
)
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    action: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    kind: int
    length: int


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def host_rule(action: str, name: str) -> Rule:
    """The rule `host/path` as an anchored expression over the url's host and path."""
    host, _, path = name.partition("/")
    whole = re.findall("[a-z0-9]+", host.lower())
    # The path's last token may go on in the url, so only those that a separator ends are literal tokens.
    whole += re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(action, name, rf"^(?:[^/]*\.)?{re.escape(host.lower())}/{re.escape(path)}", tuple(whole), 1, len(name))


def pattern_rule(action: str, regex: str, tokens: tuple[str, ...]) -> Rule:
    return Rule(action, regex, regex, tokens, 0, len(regex))


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after_scheme(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    tail = F.substring_index(F.substring_index(_after_scheme(url), "?", 1), "#", 1)
    slash = F.instr(tail, "/")
    return F.when(slash > 0, F.substring(tail, slash, F.length(tail))).otherwise(F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rarest_tokens(urls: DataFrame, rules: list[Rule], url_col: str) -> dict[str, int]:
    """How many urls hold each literal token of the rules: at most one row for each token of the list."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    spark = urls.sparkSession
    asked = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(wanted)), "array<string>")).alias("token"))
    # The list is the driver's own, so its size is known; other tokens go before anything is shuffled.
    held = urls.select(F.explode(tokens_of(F.col(url_col))).alias("token")).join(F.broadcast(asked), "token", "left_semi")
    counts = held.groupBy("token").count()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in counts.collect()}


def _index(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    slots = 1
    while slots < 2 * len(rules):
        slots *= 2
    filed: list[list[dict]] = [[] for _ in range(slots)]
    for r in rules:
        token = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=NO_TOKEN)
        filed[zlib.crc32(token.encode()) % slots].append({"kind": r.kind, "length": r.length, "name": r.name, "action": r.action, "regex": r.regex, "token": token})
    return F.from_json(F.lit(json.dumps(filed)), "array<array<struct<kind:int,length:int,name:string,action:string,regex:string,token:string>>>"), slots


def judge(urls: DataFrame, rules: list[Rule] | None = None, *, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """All columns of urls with host, path, rule, verdict and the number of rules whose expressions ran."""
    if rules is None:
        rules = [host_rule(*r) for r in RULES] + [pattern_rule(*p) for p in PATTERNS]
    index, slots = _index(rules, rarest_tokens(urls, rules, url_col))
    url = F.coalesce(F.col(url_col), F.lit(""))
    # One-element arrays name a value once, so that the lambdas below do not compute it again.
    parts = F.struct(host_of(url).alias("host"), path_of(url).alias("path"))

    def found(p: Column) -> Column:
        text = F.concat(p["host"], p["path"])
        tokens = tokens_of(text) if all(r.tokens for r in rules) else F.array_append(tokens_of(text), F.lit(NO_TOKEN))
        own = F.transform(tokens, lambda t: F.filter(F.element_at(index, (F.crc32(t.cast("binary")) % slots + 1).cast("int")), lambda r: r["token"] == t))
        candidates = F.flatten(own)
        fits = F.filter(candidates, lambda r: F.regexp_like(text, r["regex"]))
        best = F.array_max(F.transform(fits, lambda r: F.struct(r["kind"].alias("kind"), r["length"].alias("length"), r["name"].alias("name"), r["action"].alias("action"))))
        return F.struct(p["host"].alias("host"), p["path"].alias("path"), best.alias("best"), F.size(candidates).alias("n_run"))

    judged = F.element_at(F.transform(F.array(parts), found), 1)
    kept = [F.col(c) for c in urls.columns if c not in ("host", "path", "rule", "verdict", "n_run")]
    out = urls.select(*kept, judged.alias("__judged"))
    best = F.col("__judged.best")
    return out.select(
        *kept,
        F.col("__judged.host").alias("host"),
        F.col("__judged.path").alias("path"),
        F.when(best["kind"] == 1, best["name"]).alias("rule"),
        F.coalesce(best["action"], F.lit(default)).alias("verdict"),
        F.col("__judged.n_run").alias("n_run"),
    )
