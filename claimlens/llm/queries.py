"""The queries over the operators of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import fingerprints, importance, language_id, lexical_search, mixing, near_duplicates, ngram_join, packing, pitman_yor, quality_classifier, quality_rules, suffix_dedup, url_rules
from claimlens.llm.tables import read, stage_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.with_statistics(read(spark, sf_dir, "documents"), keep=["doc_id"])
    stats = stage_table(stats, "statistics")
    rules = quality_rules.fit(stats, read(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, rules, ["doc_id"]).select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_components(read(spark, sf_dir, "documents"), width=2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = fingerprints.edited_fingerprints(docs)
    digests = rows.select(F.col("fingerprint").alias("digest"), "doc_id")
    groups = fingerprints.exact_groups(docs, digests).groupBy("doc_id").agg(F.min("same_id").alias("same_id"))
    return rows.join(groups, rows["doc_id"].eqNullSafe(groups["doc_id"]), "left").select(rows["*"], "same_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_documents(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "times", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(read(spark, sf_dir, "documents"))
    return lexical_search.search(index, read(spark, sf_dir, "benchmark"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_url_rules": op4_url_rules,
    "op5_pitman_yor": op5_pitman_yor,
    "op6_fingerprints": op6_fingerprints,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_importance": op12_importance,
    "op13_ngram_join": op13_ngram_join,
}

_OP4 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), c AS (
  SELECT *, '.' || host AS h FROM p
), r AS (
  SELECT page_id, host, path,
    CASE WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(host || path, '^[^/]*/(?:.*/)?login(?:/|$)') OR regexp_matches(host || path, '^(?:.*\.)?casino\.') OR regexp_matches(host || path, '^(?:.*\.)?ads\.') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""

_OP8 = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS hash
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3.0::DOUBLE * sum(size)) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM s GROUP BY source
), lv AS (
  SELECT 0 AS i, (SELECT sum(source_size)::DOUBLE / sum(w) FROM per) AS level
  UNION ALL
  SELECT i + 1, coalesce((SELECT ((SELECT sum(source_size)::DOUBLE FROM per) - coalesce(sum(CASE WHEN w * level > cap THEN cap END), 0.0::DOUBLE)) / sum(CASE WHEN w * level <= cap THEN w END) FROM per), level)
  FROM lv WHERE i < 60
), t AS (
  SELECT source, source_size, CASE WHEN w * level > cap THEN cap ELSE w * level END AS target FROM per, (SELECT level FROM lv WHERE i = 60)
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT s.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE UNBOUNDED PRECEDING) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS own
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source
), k AS (
  SELECT *, least(whole + CASE WHEN upto <= rest OR (upto - rest) < (rest - (upto - own)) THEN 1 ELSE 0 END, 3)::BIGINT AS times FROM c
)
SELECT doc_id, size, source_size, target, times, (size * times)::BIGINT AS taken FROM k
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL
), n AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL
), a AS (
  SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM n
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT N FROM a) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p GROUP BY ALL
), m AS (
  SELECT doc_id, 100 - 50 + ((50 * n * (SELECT N FROM a)) // (SELECT L FROM a)) AS m FROM n
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM b JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

_OP12 = rf"""
WITH c AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS tab
), t AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM t
), k AS (
  SELECT side, id, feature, count(*)::BIGINT AS n FROM f GROUP BY ALL
), h AS (
  SELECT feature, hex(encode(feature)) AS x FROM (SELECT DISTINCT feature FROM k)
), q AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT)),
                                  lambda r, y: xor(r >> 8, tab[(xor(r, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, c
), g AS (
  SELECT side, id, bucket, n FROM k JOIN q USING (feature)
), z AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM g GROUP BY ALL
), e AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM z) + 10000) / ((s + 1) * ((SELECT sum(t) FROM z) + 10000)))) AS BIGINT) AS gain FROM z
), v AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)) AS BIGINT) AS weight FROM g JOIN e USING (bucket) WHERE side = 0 GROUP BY ALL
), u AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(len(w), 0) AS words,
         ('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM (SELECT id AS doc_id, w FROM t WHERE side = 0) LEFT JOIN v USING (doc_id)
), y AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM u
), o AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM y WHERE words >= 20
)
SELECT y.doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM o) THEN place END AS rank FROM y LEFT JOIN o USING (doc_id)
"""

_OP13 = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM t WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY ALL
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*)::BIGINT AS inter FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * inter >= 80 * (p.n + q.n - inter)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b
), m AS (
  SELECT id, min(low) AS component_id FROM r GROUP BY ALL
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op13_ngram_join": _OP13, "op4_url_rules": _OP4, "op8_mixing": _OP8, "op11_lexical_search": _OP11, "op12_importance": _OP12}
