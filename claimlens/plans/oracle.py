"""The same results in SQL that DuckDB runs over the driver's tables."""

from __future__ import annotations

from claimlens.functions import measures, names, urls
from claimlens.plans.queries import MAX_RATE, MOMENT_US
from claimlens.plans.views import FILES, LOG, REGISTRY, in_duckdb


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_F = f"f AS ({in_duckdb(FILES)})"
_L = f"l AS ({in_duckdb(LOG)})"
_R = f"r AS ({in_duckdb(REGISTRY)})"
_FOUND = f"""{_F}, a AS (SELECT page_id, url, regexp_extract_all(body, {_text(names.REFERENCE)}, 1) AS x FROM f),
m AS (SELECT page_id, url, unnest(x) AS name, (generate_subscripts(x, 1) - 1)::BIGINT AS pos FROM a),
n AS (SELECT *, CASE WHEN starts_with(name, '@') THEN CASE WHEN instr(name, '/') > 0 THEN split_part(name, '/', 1) || '/' || split_part(name, '/', 2) ELSE name END ELSE split_part(name, '/', 1) END AS package FROM m),
k AS (SELECT * FROM n WHERE left(package, 1) NOT IN ('.', '/', '\\') AND strlen(package) >= 2)"""
_FIRST = f"{_FOUND}, o AS (SELECT package, arg_min(url, page_id * 1000000 + pos) AS source_url FROM k GROUP BY package)"
_FINDINGS = f"{_FIRST}, {_R}, g AS (SELECT package AS unclaimed_package, source_url FROM o WHERE package NOT IN (SELECT package FROM r WHERE status IS NULL OR error IS NOT NULL OR status <> 404))"
_OUTCOME = f"""{_FIRST}, {_R}, v AS (SELECT o.package, source_url, CASE WHEN r.package IS NULL THEN 404 ELSE status END::BIGINT AS status,
CASE WHEN r.package IS NULL THEN 'unclaimed' WHEN status IS NULL OR error IS NOT NULL THEN 'failed' WHEN status = 404 THEN 'unclaimed' WHEN status = 200 THEN 'claimed' ELSE 'unknown' END AS outcome FROM o LEFT JOIN r ON o.package = r.package)"""
_SPEC = """s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@' || replace(p_name, ' ', '/') || '/deep' WHEN 1 THEN replace(p_name, ' ', '-') || '/client'
WHEN 2 THEN './' || replace(p_name, ' ', '-') WHEN 3 THEN left(p_name, 1) ELSE '  ' || replace(p_name, ' ', '-') || ' ' END AS name FROM part),
n AS (SELECT p_partkey, CASE WHEN starts_with(trim(name), '@') THEN split_part(trim(name), '/', 1) || '/' || split_part(trim(name), '/', 2) ELSE split_part(trim(name), '/', 1) END AS package FROM s)"""
_HOST = f"nullif(CASE WHEN regexp_extract(url, {_text(urls.HOST)}, 1) <> '' THEN regexp_extract(url, {_text(urls.HOST)}, 1) ELSE regexp_extract(url, {_text(urls.HOST)}, 2) END, '')"
_PROXY = """p AS (SELECT s_suppkey, 'p' || s_suppkey || '.example' AS own FROM supplier),
x AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'http://' || own || ':8080' WHEN 1 THEN 'http://user:word@' || own || ':8080' WHEN 2 THEN 'socks5://' || own || ':1080' END AS url FROM p)"""
_REPLAY = f"""{_L}, e AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM l),
z AS (
  SELECT host, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0::BIGINT AS eff, 2.0::DOUBLE AS rate, 0::INT AS retry, 0::BIGINT AS nxt, 0::BIGINT AS sent, 0::BIGINT AS delayed, 0::BIGINT AS rejected, false AS refused, 0::INT AS status
  FROM (SELECT DISTINCT host FROM e)
  UNION ALL
  SELECT host, rn, event_id, CASE WHEN refused THEN us ELSE greatest(us, nxt) END,
    CASE WHEN refused THEN rate WHEN status = 429 THEN greatest(rate * 0.7::DOUBLE, 0.1::DOUBLE) ELSE least(rate + 0.2::DOUBLE, {MAX_RATE}::DOUBLE) END,
    CASE WHEN NOT refused AND status = 429 THEN retry + 1 ELSE retry END,
    CASE WHEN NOT refused AND status = 429 THEN greatest(us, nxt) + least(CAST(pow(2, retry + 2) AS BIGINT), 60) * 1000000 ELSE nxt END,
    sent + CASE WHEN refused THEN 0 ELSE 1 END, delayed + CASE WHEN NOT refused AND us < nxt THEN 1 ELSE 0 END, rejected + CASE WHEN refused THEN 1 ELSE 0 END, refused, status
  FROM (SELECT z.host, e.rn, e.event_id, e.us, e.status, z.rate, z.retry, z.nxt, z.sent, z.delayed, z.rejected, z.retry > 5 AS refused FROM z JOIN e ON e.host = z.host AND e.rn = z.rn + 1)
),
t AS (SELECT host, max(rn) AS rn FROM z GROUP BY host),
h AS (SELECT z.* FROM z JOIN t USING (host, rn))"""
# The requests that are let through, with the rate and moment each finds, and the tokens that its host's bucket then has.
_BUCKET = f"""{_REPLAY}, a AS (SELECT host, rn, refused, eff, lag(rate) OVER (PARTITION BY host ORDER BY rn) AS rate FROM z),
y AS (SELECT * FROM a WHERE rn > 0 AND NOT refused),
k AS (
  SELECT host, 0::BIGINT AS rn, NULL::BOOLEAN AS refused, NULL::BIGINT AS wait, 2.0::DOUBLE AS tokens, NULL::BIGINT AS latest FROM t
  UNION ALL
  SELECT host, rn, refused, CASE WHEN filled >= 1 THEN 0 ELSE CAST(trunc((1 - filled) / rate * 1000000) AS BIGINT) END, filled - 1, greatest(eff, coalesce(latest, eff))
  FROM (SELECT y.host, y.rn, y.refused, y.rate, y.eff, k.latest, least(2.0::DOUBLE, k.tokens + CASE WHEN k.latest IS NULL THEN 0 ELSE greatest(0, y.eff - k.latest) END / 1000000.0::DOUBLE * y.rate) AS filled
        FROM k JOIN y ON y.host = k.host AND y.rn = k.rn + 1)
)"""
_BLOCKED = f"b AS (SELECT host, max(nxt) AS next_attempt_us FROM z JOIN e USING (host, rn) WHERE e.us <= {MOMENT_US} GROUP BY host HAVING max(nxt) >= {MOMENT_US})"
_PENDING = "q AS (SELECT host, sum(CASE job_type WHEN 'FetchJS' THEN 1 ELSE -1 END)::BIGINT AS pending FROM l GROUP BY host)"
_QUEUE = f"{_REPLAY}, {_BLOCKED}, {_PENDING}"
_ETA = """CASE WHEN current = 0 OR elapsed < 1 THEN 'calculating...' WHEN total <= current OR remains <= 0 THEN 'done' WHEN remains < 60 THEN remains || 's'
WHEN remains < 3600 THEN (remains // 60) || 'm' || (remains % 60) || 's' ELSE (remains // 3600) || 'h' || (remains % 3600 // 60) || 'm' END"""

# Forms of the bodies by page_id % 6: what syntax shows there, by the names that the view makes them of.
_NAMES = """y AS (SELECT p.page_id, replace(t.p_name, ' ', '-') AS pk, replace(t.p_name, ' ', '.') AS dk, replace(t.p_name, ' ', '') AS wk, lower(replace(t.p_type, ' ', '-')) AS ty FROM pages p JOIN part t ON t.p_partkey = p.page_id)"""
_SYNTAX = """d AS (SELECT page_id, unnest(x) AS name, (generate_subscripts(x, 1) - 1)::BIGINT AS pos FROM s),
n AS (SELECT *, CASE WHEN starts_with(name, '@') THEN split_part(name, '/', 1) || '/' || split_part(name, '/', 2) ELSE split_part(name, '/', 1) END AS package FROM d)"""
_WORTH = "left(package, 1) NOT IN ('.', '/', '\\') AND strlen(package) >= 2"

SQL: dict[str, str] = {
    "deep_refs_full": f"""WITH {_NAMES}, s AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN [pk, '@' || ty || '/' || dk] WHEN 1 THEN [wk, pk] WHEN 2 THEN [pk, wk] WHEN 3 THEN [pk || '/sub', 'x', wk]
WHEN 4 THEN [wk] ELSE [wk, '@' || ty || '/' || wk || '/deep'] END AS x FROM y), {_SYNTAX} SELECT page_id, pos, package FROM n WHERE {_WORTH}""",
    "deep_refs_strict": f"""WITH {_NAMES}, s AS (SELECT page_id, CASE page_id % 6 WHEN 3 THEN [pk || '/sub', 'x', wk] WHEN 5 THEN ['@' || ty || '/' || wk || '/deep'] ELSE [] END AS x FROM y), {_SYNTAX},
{_F}, a AS (SELECT page_id, regexp_extract_all(body, {_text(names.REFERENCE)}, 1) AS x FROM f WHERE page_id % 6 NOT IN (3, 5)),
m AS (SELECT page_id, unnest(x) AS name, (generate_subscripts(x, 1) - 1)::BIGINT AS pos FROM a),
w AS (SELECT page_id, pos, CASE WHEN starts_with(name, '@') THEN CASE WHEN instr(name, '/') > 0 THEN split_part(name, '/', 1) || '/' || split_part(name, '/', 2) ELSE name END ELSE split_part(name, '/', 1) END AS package FROM m)
SELECT page_id, pos, package FROM n WHERE {_WORTH} UNION ALL SELECT page_id, pos, package FROM w WHERE {_WORTH}""",
    "deep_syntax": """SELECT p_partkey, mode, CASE WHEN p_partkey % 8 IN (0, 5) THEN 'a' ELSE '' END || CASE WHEN p_partkey % 8 = 7 THEN 'ab' ELSE replace(p_name, ' ', '-') END AS package
FROM part, (VALUES ('deep_strict'), ('deep_full')) m(mode) WHERE mode = 'deep_full' OR p_partkey % 8 NOT IN (6, 7)""",
    "deep_fallback": f"WITH {_NAMES} SELECT page_id, page_id % 6 NOT IN (3, 5) AS fallback FROM y",
    "body_text": """WITH d AS (SELECT doc_id, text, list_max(list_filter(range(0, 1025), lambda k: strlen(left(text, k)) <= 1024 AND k <= length(text))) AS k FROM documents),
c AS (SELECT doc_id, left(text, k) || CASE WHEN strlen(left(text, k)) < least(1024, strlen(text)) THEN chr(65533) ELSE '' END AS body FROM d)
SELECT doc_id, length(body)::BIGINT AS n_chars, md5(body) AS md5 FROM c""",
    "flagship_unclaimed": f"WITH {_FINDINGS} SELECT * FROM g",
    "refs_regex": f"WITH {_FOUND} SELECT page_id, pos, name FROM m",
    "refs_per_file": f"WITH {_FOUND} SELECT page_id, len(x)::BIGINT AS n_refs FROM a",
    "normalize_names": f"WITH {_SPEC} SELECT * FROM n",
    "worth_checking": f"WITH {_SPEC} SELECT p_partkey, left(package, 1) NOT IN ('.', '/', '\\') AND strlen(package) >= 2 AS worth FROM n",
    "first_source_per_package": f"WITH {_FIRST} SELECT * FROM o",
    "first_reference_rows": f"WITH {_FOUND} SELECT package, page_id, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY page_id, pos) AS i FROM k) WHERE i = 1",
    "claimed_packages": f"WITH {_FIRST}, {_R} SELECT * FROM o WHERE package IN (SELECT package FROM r WHERE status = 200)",
    "verify_outcome": f"WITH {_OUTCOME} SELECT * FROM v",
    "outcome_counts": f"WITH {_OUTCOME} SELECT outcome, count(*) AS n FROM v GROUP BY outcome",
    "findings_count": f"WITH {_FINDINGS} SELECT count(*) AS n FROM g",
    "target_hosts": f"SELECT page_id, regexp_matches(url, '^https?://') AS remote, {_HOST} AS host FROM pages",
    "distinct_hosts": f"SELECT count(DISTINCT {_HOST}) AS n_hosts, count(*) AS n_targets FROM pages",
    "same_host_pairs": f"SELECT host, (n * (n - 1) // 2)::BIGINT AS n_pairs FROM (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1) WHERE n > 1 AND host IS NOT NULL",
    "base_url": f"SELECT page_id, regexp_extract(url, {_text(urls.BASE)}, 1) || regexp_extract(url, {_text(urls.BASE)}, 2) AS base FROM pages",
    "registry_url": f"WITH {_SPEC} SELECT p_partkey, {_text(urls.REGISTRY)} || replace(package, '/', '%2F') AS url FROM n WHERE package <> ''",
    "proxy_parse": f"WITH {_PROXY} SELECT * FROM x WHERE url IS NOT NULL",
    "proxy_live": f"WITH {_PROXY} SELECT * FROM x WHERE url IS NOT NULL AND s_suppkey % 3 = 0 AND s_suppkey % 7 <> 0",
    "header_map": "SELECT c_custkey, 4::BIGINT AS n, 'again ' || c_custkey AS customer, c_mktsegment AS segment, 'http://x/' || c_custkey AS referer, 'scanner' AS agent FROM customer",
    "proxy_round_robin": "SELECT page_id AS seq, url, 'http://p' || (page_id % 3) || ':8080' AS proxy FROM pages",
    "size_gate": "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents WHERE strlen(text) <= 2048",
    "body_truncate": "SELECT doc_id, least(strlen(text), 1024)::BIGINT AS size, md5(encode(text)[1:1024]) AS md5, strlen(text) >= 1024 AS cut FROM documents",
    "extension_filter": """SELECT * FROM (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 6 WHEN 0 THEN '.js' WHEN 1 THEN '.TS' WHEN 2 THEN '.jsx' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.mjs' ELSE '.Js' END AS file FROM part)
WHERE lower(file) LIKE '%.js' OR lower(file) LIKE '%.ts'""",
    "target_union": "SELECT target, count(*) AS n FROM (SELECT url AS target FROM pages UNION ALL SELECT CASE WHEN doc_id % 3 <> 0 THEN '/src/' || doc_id || '.js' ELSE '' END FROM documents) WHERE target <> '' GROUP BY target",
    "status_route": f"WITH {_L} SELECT event_id, CASE WHEN status = 429 THEN 'retry' WHEN status >= 400 THEN 'fail' ELSE 'ok' END AS route FROM l",
    "retry_outcome": f"""WITH {_L}, a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS attempt FROM l),
g AS (SELECT job_id, min(attempt) FILTER (status <> 429) AS hit, arg_min(status, attempt) FILTER (status <> 429) AS st, max(attempt) AS last FROM a WHERE attempt <= 4 GROUP BY job_id)
SELECT job_id, coalesce(hit, last)::BIGINT AS attempts, coalesce(st, 429)::BIGINT AS status, CASE WHEN hit IS NULL AND last >= 4 THEN 'exhausted' WHEN hit IS NULL THEN 'waiting' WHEN st < 400 THEN 'ok' ELSE 'fail' END AS outcome FROM g""",
    "rate_state_final": f"WITH RECURSIVE {_REPLAY} SELECT host, rate, retry AS retry_counter, nxt AS next_attempt_us, retry > 5 AS discarded, sent, delayed, rejected FROM h",
    "rate_state_trace": f"WITH RECURSIVE {_REPLAY} SELECT event_id, host, rate, retry AS retry_counter, eff AS effective_us, refused AS rejected, retry > 5 AS discarded FROM z WHERE rn > 0",
    "discarded_hosts": f"WITH RECURSIVE {_REPLAY} SELECT host, retry AS retry_counter FROM h WHERE retry > 5",
    "rejected_requests": f"WITH RECURSIVE {_REPLAY} SELECT event_id, host FROM z WHERE refused",
    "backoff_schedule": f"WITH {_L}, c AS (SELECT host, count(*) AS n FROM l WHERE status = 429 GROUP BY host) SELECT host, n, CASE WHEN n < 5 THEN 2 << n::INT ELSE 60 END::BIGINT AS seconds FROM c",
    "blocked_hosts_at": f"WITH RECURSIVE {_REPLAY}, {_BLOCKED} SELECT * FROM b",
    "pending_by_host": f"WITH {_L}, {_PENDING} SELECT * FROM q",
    "available_hosts": f"WITH RECURSIVE {_QUEUE} SELECT * FROM q WHERE pending > 0 AND host NOT IN (SELECT host FROM b)",
    "queue_without_blocked": f"WITH RECURSIVE {_QUEUE} SELECT event_id, host FROM l WHERE host NOT IN (SELECT host FROM b)",
    "queue_stats": f"""WITH RECURSIVE {_QUEUE} SELECT (SELECT count(*) FROM q) AS total_domains, (SELECT count(*) FROM q WHERE pending > 0 AND host NOT IN (SELECT host FROM b)) AS available_domains,
(SELECT count(*) FROM b) AS blocked_domains, coalesce((SELECT string_agg(host, ',' ORDER BY host) FROM b), '') AS blocked_list, (SELECT count(*) FROM q WHERE pending > 0) AS n_counts, (SELECT coalesce(sum(pending), 0)::BIGINT FROM q WHERE pending > 0) AS sum_counts""",
    "queue_hosts": f"""WITH RECURSIVE {_QUEUE} SELECT coalesce(q.host, b.host) AS host, coalesce(pending, 0)::BIGINT AS pending, b.host IS NOT NULL AS blocked, coalesce(pending, 0) > 0 AND b.host IS NULL AS available
FROM q FULL JOIN b ON q.host = b.host""",
    "random_host_choice": f"WITH RECURSIVE {_QUEUE} SELECT host, pending FROM q WHERE pending > 0 AND host NOT IN (SELECT host FROM b) ORDER BY md5('7 ' || host), host LIMIT 1",
    "request_count": f"WITH {_L} SELECT count(*) AS n FROM l WHERE job_type IN ('FetchJS', 'VerifyPackage')",
    "token_bucket": f"WITH RECURSIVE {_BUCKET} SELECT host, count(*) FILTER (wait > 0) AS held, sum(wait)::BIGINT AS wait_us FROM k WHERE NOT refused GROUP BY host",
    "stream_throughput": """WITH s AS (SELECT (epoch_us(ts) // 2000000 * 2)::BIGINT AS tick, count(*) AS n FROM events GROUP BY 1),
g AS (SELECT unnest(range((SELECT min(tick) FROM s), (SELECT max(tick) FROM s) + 2, 2)) AS tick) SELECT tick, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / 2.0::DOUBLE AS rps FROM g LEFT JOIN s USING (tick)""",
    "redistribute_quantum": f"""WITH RECURSIVE {_REPLAY} SELECT event_id, host AS from_host, NULL::VARCHAR AS host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY event_id) AS i FROM l WHERE host IN (SELECT host FROM h WHERE retry > 5)) WHERE i <= 5""",
    "redistribute_all": f"WITH RECURSIVE {_REPLAY} SELECT host AS from_host, count(*) AS n FROM l WHERE host IN (SELECT host FROM h WHERE retry > 5) GROUP BY host",
    "host_affinity": f"""WITH RECURSIVE {_QUEUE}, p AS (SELECT *, row_number() OVER (ORDER BY host) - 1 AS place, count(*) OVER () AS n FROM q),
w AS (SELECT worker::BIGINT AS worker, host, (place - worker % n + n) % n AS turn FROM p, (SELECT unnest([0, 7, 23]) AS worker) WHERE pending > 0 AND host NOT IN (SELECT host FROM b))
SELECT worker, arg_min(host, turn) AS host FROM w GROUP BY worker""",
    "rps_ticks": f"""WITH {_L}, s AS (SELECT (epoch_us(ts) // 2000000 * 2)::BIGINT AS tick, count(*) AS n FROM l GROUP BY 1),
g AS (SELECT unnest(range((SELECT min(tick) FROM s), (SELECT max(tick) FROM s) + 2, 2)) AS tick) SELECT tick, coalesce(n, 0)::BIGINT AS n, coalesce(n, 0) / 2.0::DOUBLE AS rps FROM g LEFT JOIN s USING (tick)""",
    "progress_trace": f"""WITH {_L}, d AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS current, count(*) OVER () AS total, min(epoch_us(ts)) OVER () AS start FROM l WHERE job_type = 'FetchJS'),
c AS (SELECT *, (us - start) / 1000000.0::DOUBLE AS elapsed FROM d), g AS (SELECT *, CAST(floor(elapsed / current * (total - current)) AS BIGINT) AS remains FROM c)
SELECT event_id, current::BIGINT AS current, current::DOUBLE / total * 100 AS percent, {_ETA} AS eta FROM g""",
    "log_filter": "SELECT * FROM (SELECT event_id, (['INFO', 'DEBUG', 'WARN', 'ERROR', 'SUCCESS', 'WARN_PUBLIC', 'FATAL'])[event_id % 7 + 1] AS level FROM events) WHERE level IN ('INFO', 'SUCCESS', 'WARN_PUBLIC', 'FATAL')",
    "settings_line": """SELECT r_regionkey, 'Settings: ' || concat_ws(', ', 'Rate Limit: Auto (Max ' || (r_regionkey + 25) || '/s)', CASE WHEN r_regionkey % 2 = 1 THEN 'File Size Limit: Disabled' ELSE 'File Size Limit: 10240 KB' END,
CASE WHEN r_regionkey % 3 = 0 THEN 'Deep Scan: Enabled' END, CASE WHEN r_regionkey % 4 = 1 THEN 'TLS Verification: Disabled' END, CASE WHEN r_regionkey > 1 THEN 'Custom Headers: ' || (r_regionkey - 1) END,
CASE WHEN r_regionkey > 2 THEN 'Using ' || (r_regionkey - 2) || ' Live Proxies' WHEN r_regionkey = 2 THEN 'Proxy: None (check failed)' END) AS line FROM region""",
    "host_with_scheme": f"SELECT page_id, {_HOST} AS host FROM pages",
    "clocks_and_sizes": "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, (strlen(props) * 1024)::BIGINT AS bytes, (strlen(props) * 100 // 1024)::BIGINT AS kb FROM events",
    "progress_bars": "SELECT p_partkey, rpad(repeat('█', floor(p_size::DOUBLE / 50 * 100 / 100 * 40)::INT), 40, ' ') AS bar FROM part",
    "fifo_order": f"WITH {_L} SELECT host, min(event_id) AS head, max(event_id) AS tail, count(*) AS n FROM l GROUP BY host",
    "refresh_needed": f"WITH RECURSIVE {_QUEUE} SELECT (SELECT count(*) FROM q WHERE pending > 0 AND host NOT IN (SELECT host FROM b)) < (SELECT count(*) FROM q) // 3 AS refresh",
    "job_types": f"WITH {_L} SELECT c.code::BIGINT AS code, c.job_type, count(*) AS n FROM l JOIN (VALUES {', '.join(f'({i}, {_text(x)})' for i, x in enumerate(measures.JOB_TYPES))}) c(code, job_type) ON c.job_type = l.job_type GROUP BY 1, 2",
    "report_lines": f"WITH {_FINDINGS} SELECT 0::BIGINT AS ord, 'Found ' || count(*) || ' unclaimed dependencies:' AS line FROM g HAVING count(*) > 0 UNION ALL SELECT 1, '  [+] Package: ' || unclaimed_package || chr(10) || '      Source:  ' || source_url FROM g",
    "listed_targets": """SELECT * FROM (SELECT 'd' || page_id % 7 || CASE page_id % 3 WHEN 0 THEN '/.hid/' WHEN 1 THEN '/_pages/' ELSE '/' END || CASE page_id % 2 WHEN 0 THEN '_' ELSE '.' END || page_id ||
CASE page_id % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.TS' WHEN 2 THEN '.jsx' ELSE '.d.ts' END AS target FROM pages) WHERE lower(target) LIKE '%.js' OR lower(target) LIKE '%.ts'""",
    "report_file": f"""WITH {_FINDINGS} SELECT 'Found ' || count(*) || ' unclaimed dependencies:' AS line FROM g HAVING count(*) > 0
UNION ALL SELECT '  [+] Package: ' || unclaimed_package FROM g UNION ALL SELECT '      Source:  ' || source_url FROM g""",
    "stream_dedupe": f"WITH {_FIRST} SELECT package FROM o",
}
SQL["stream_rate_state"] = SQL["rate_state_final"]
SQL["stream_first_source"] = SQL["first_source_per_package"]
SQL["unclaimed_by_filter"] = SQL["flagship_unclaimed"]
SQL["stream_findings"] = SQL["flagship_unclaimed"]
