"""One query for each operator, over the deterministic views."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions import measures, names, urls
from claimlens.operators import filters, metrics, queueing, ratecontrol, registry
from claimlens.operators import references as refs
from claimlens.operators.deep import strict_or_null
from claimlens.plans.views import fetch_log, files, table
from claimlens.plans.views import registry as registry_log
from claimlens.session import shared_dir
from claimlens.sources import files as bodies
from claimlens.sources import datasource, network, sinks, targets
from claimlens.streaming import findings as stream_findings_
from claimlens.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: A moment on 2024-01-03 in microseconds, and the rate limit of the replays.
MOMENT_US = 1_704_254_100_000_000
MAX_RATE = 30.0


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _firsts(spark: SparkSession, sf: str) -> DataFrame:
    return refs.first_sources(refs.references(files(spark, sf)))


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    return registry.unclaimed(_firsts(spark, sf), registry_log(spark, sf))


@_query
def flagship_unclaimed(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).orderBy("unclaimed_package")


@_query
def refs_regex(spark: SparkSession, sf: str) -> DataFrame:
    return refs.raw_references(files(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "name")


@_query
def refs_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return refs.references_per_file(files(spark, sf)).select("page_id", "n_refs")


def _specifiers(spark: SparkSession, sf: str) -> DataFrame:
    p, key = F.col("p_name"), F.col("p_partkey")
    dashed = F.replace(p, F.lit(" "), F.lit("-"))
    text = F.when(key % 5 == 0, F.concat(F.lit("@"), F.replace(p, F.lit(" "), F.lit("/")), F.lit("/deep"))).when(key % 5 == 1, F.concat(dashed, F.lit("/client"))).when(key % 5 == 2, F.concat(F.lit("./"), dashed)).when(key % 5 == 3, F.substring(p, 1, 1)).otherwise(F.concat(F.lit("  "), dashed, F.lit(" ")))
    return table(spark, sf, "part").select("p_partkey", text.alias("name"))


@_query
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    return _specifiers(spark, sf).select("p_partkey", names.normalized(F.col("name")).alias("package"))


@_query
def worth_checking(spark: SparkSession, sf: str) -> DataFrame:
    rows = normalize_names(spark, sf)
    return rows.select("p_partkey", names.worth_checking(F.col("package")).alias("worth"))


@_query
def first_source_per_package(spark: SparkSession, sf: str) -> DataFrame:
    return _firsts(spark, sf)


@_query
def first_reference_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = refs.first_references(refs.references(files(spark, sf)))
    return rows.select("package", "page_id", F.col("pos").cast("bigint").alias("pos"), "url")


@_query
def claimed_packages(spark: SparkSession, sf: str) -> DataFrame:
    return registry.claimed(_firsts(spark, sf), registry_log(spark, sf))


@_query
def verify_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return registry.outcomes(_firsts(spark, sf), registry_log(spark, sf))


@_query
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return verify_outcome(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))


@_query
def findings_count(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf).agg(F.count("*").alias("n"))


@_query
def target_hosts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.is_remote(url).alias("remote"), urls.host(url).alias("host"))


@_query
def distinct_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").agg(F.countDistinct(urls.host(F.col("url"))).alias("n_hosts"), F.count("*").alias("n_targets"))


@_query
def same_host_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """How many pages share their host, by host: pairs are counted, not made."""
    own = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"))
    sizes = own.where("host is not null").groupBy("host").agg(F.count("*").alias("n"))
    return sizes.where("n > 1").select("host", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("n_pairs"))


@_query
def base_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.base_url(F.col("url")).alias("base"))


@_query
def registry_url(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_names(spark, sf).where("package <> ''").select("p_partkey", urls.registry_url(F.col("package")).alias("url"))


def _proxies(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = F.concat(F.lit("p"), k.cast("string"), F.lit(".example"))
    text = F.when(k % 4 == 0, F.concat(own, F.lit(":8080"))).when(k % 4 == 1, F.concat(own, F.lit(":8080:user:word"))).when(k % 4 == 2, F.concat(F.lit("socks5://"), own, F.lit(":1080"))).otherwise(own)
    return table(spark, sf, "supplier").select(k, text.alias("proxy"))


@_query
def proxy_parse(spark: SparkSession, sf: str) -> DataFrame:
    return network.parsed_proxies(_proxies(spark, sf)).select("s_suppkey", "url")


@_query
def proxy_live(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    probes = network.parsed_proxies(_proxies(spark, sf)).select(k, "url", F.when(k % 3 == 0, 204).otherwise(200).alias("status"), F.when(k % 7 == 0, "timeout").alias("error"))
    return network.live_proxies(probes).select("s_suppkey", "url")


@_query
def header_map(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey").cast("string")
    texts = F.array(F.concat(F.lit("X-Customer: "), c), F.concat(F.lit("X-Segment:"), F.col("c_mktsegment")), F.lit("NoColon"), F.concat(F.lit("X-Customer: again "), c), F.concat(F.lit("Referer: http://x/"), c))
    made = network.header_map(texts, agent="scanner")
    got = table(spark, sf, "customer").select("c_custkey", made.alias("m"))
    return got.select("c_custkey", F.size("m").cast("bigint").alias("n"), *[F.col("m")[k].alias(a) for k, a in (("X-Customer", "customer"), ("X-Segment", "segment"), ("Referer", "referer"), ("User-Agent", "agent"))])


@_query
def proxy_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    proxies = spark.range(3).select(F.col("id").alias("idx"), F.concat(F.lit("http://p"), F.col("id").cast("string"), F.lit(":8080")).alias("proxy"))
    return queueing.round_robin(table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url"), proxies).select("seq", "url", "proxy")


@_query
def size_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(bodies.within_limit(F.octet_length("text"), 2)).select("doc_id", F.octet_length("text").cast("bigint").alias("size"))


@_query
def body_truncate(spark: SparkSession, sf: str) -> DataFrame:
    part, cut = bodies.truncated(F.encode("text", "UTF-8"), 1)
    return table(spark, sf, "documents").select("doc_id", F.octet_length(part).cast("bigint").alias("size"), F.md5(part).alias("md5"), cut.alias("cut"))


@_query
def body_text(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies cut to the limit, which may split a character, as text."""
    body = bodies.as_text(bodies.truncated(F.encode("text", "UTF-8"), 1)[0])
    return table(spark, sf, "documents").select("doc_id", F.char_length(body).cast("bigint").alias("n_chars"), F.md5(body).alias("md5"))


@_query
def extension_filter(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, (".js", ".TS", ".jsx", ".d.ts", ".mjs", ".Js"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    own = table(spark, sf, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("file"))
    return own.where(bodies.has_script_extension(F.col("file")))


@_query
def target_union(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("target_ord"), F.col("url").alias("target"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("target_ord"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("/src/"), F.col("doc_id").cast("string"), F.lit(".js"))).otherwise(F.lit("")).alias("target"))
    return targets.together(pages, docs).groupBy("target").agg(F.count("*").alias("n"))


@_query
def status_route(spark: SparkSession, sf: str) -> DataFrame:
    return fetch_log(spark, sf).select("event_id", ratecontrol.route(F.col("status")).alias("route"))


@_query
def retry_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return ratecontrol.retry_outcomes(fetch_log(spark, sf))


@_query
def rate_state_final(spark: SparkSession, sf: str) -> DataFrame:
    return ratecontrol.host_state(fetch_log(spark, sf), MAX_RATE)


@_query
def rate_state_trace(spark: SparkSession, sf: str) -> DataFrame:
    return ratecontrol.rate_trace(fetch_log(spark, sf), MAX_RATE).select("event_id", "host", "rate", "retry_counter", "effective_us", "rejected", "discarded")


@_query
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    rows = ratecontrol.rate_trace(fetch_log(spark, sf), MAX_RATE).where("not rejected")
    return rows.groupBy("host").agg(F.count(F.when(F.col("wait_us") > 0, 1)).alias("held"), F.sum("wait_us").alias("wait_us"))


@_query
def discarded_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return ratecontrol.discarded_hosts(fetch_log(spark, sf))


@_query
def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    return ratecontrol.rejected_requests(fetch_log(spark, sf))


@_query
def backoff_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """How often each host has rejected, and the backoff that its last rejection would start."""
    hit = fetch_log(spark, sf).where(F.col("status") == ratecontrol.REJECTED).groupBy("host").agg(F.count("*").alias("n"))
    return hit.select("host", "n", measures.backoff_seconds(F.col("n")).alias("seconds"))


def _blocked(spark: SparkSession, sf: str) -> DataFrame:
    return ratecontrol.blocked_at(fetch_log(spark, sf), F.lit(MOMENT_US))


@_query
def blocked_hosts_at(spark: SparkSession, sf: str) -> DataFrame:
    return _blocked(spark, sf)


def _pending(spark: SparkSession, sf: str) -> DataFrame:
    delta = F.when(F.col("job_type") == "FetchJS", 1).otherwise(-1)
    return queueing.pending(fetch_log(spark, sf).select("host", delta.alias("delta")))


@_query
def pending_by_host(spark: SparkSession, sf: str) -> DataFrame:
    return _pending(spark, sf)


@_query
def available_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return queueing.available(_pending(spark, sf), _blocked(spark, sf))


@_query
def queue_without_blocked(spark: SparkSession, sf: str) -> DataFrame:
    return queueing.unblocked(fetch_log(spark, sf).select("event_id", "host"), _blocked(spark, sf))


@_query
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = queueing.statistics(_pending(spark, sf), _blocked(spark, sf))
    total = F.aggregate(F.map_values("domain_job_counts"), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("total_domains", "available_domains", "blocked_domains", F.array_join("blocked_domain_list", ",").alias("blocked_list"), F.size("domain_job_counts").cast("bigint").alias("n_counts"), total.alias("sum_counts"))


@_query
def queue_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return queueing.by_host(_pending(spark, sf), _blocked(spark, sf))


@_query
def redistribute_quantum(spark: SparkSession, sf: str) -> DataFrame:
    queue = fetch_log(spark, sf).select("event_id", "host", F.col("event_id").alias("ord"))
    return queueing.redistributed(queue, discarded_hosts(spark, sf)).select("event_id", "from_host", "host")


@_query
def redistribute_all(spark: SparkSession, sf: str) -> DataFrame:
    queue = fetch_log(spark, sf).select("event_id", "host", F.col("event_id").alias("ord"))
    return queueing.redistributed(queue, discarded_hosts(spark, sf), None).groupBy("from_host").agg(F.count("*").alias("n"))


@_query
def host_affinity(spark: SparkSession, sf: str) -> DataFrame:
    free, blocked = _pending(spark, sf), _blocked(spark, sf)
    parts = [queueing.assigned(free, blocked, w).select(F.lit(w).cast("bigint").alias("worker"), "host") for w in (0, 7, 23)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query
def request_count(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.requests(fetch_log(spark, sf))


@_query
def rps_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ticks(fetch_log(spark, sf).select(measures.micros(F.col("ts")).alias("us")))


@_query
def progress_trace(spark: SparkSession, sf: str) -> DataFrame:
    rows = fetch_log(spark, sf).where("job_type = 'FetchJS'").select("event_id", measures.micros(F.col("ts")).alias("us"))
    n, start = rows.agg(F.count("*"), F.min("us")).first()
    return metrics.progress(rows, n, start or 0)


@_query
def log_filter(spark: SparkSession, sf: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("INFO", "DEBUG", "WARN", "ERROR", "SUCCESS", "WARN_PUBLIC", "FATAL"))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", level.alias("level")).where(metrics.shown(F.col("level")))


@_query
def settings_line(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey")
    line = measures.settings_line(k + 25, F.lit(10240), k % 2 == 1, k % 3 == 0, k % 4 == 1, k - 1, k - 2, k == 2)
    return table(spark, sf, "region").select(k, line.alias("line"))


@_query
def host_with_scheme(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", urls.host_with_default_scheme(bare).alias("host"))


@_query
def clocks_and_sizes(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "events").select("event_id", "ts", F.octet_length("props").cast("bigint").alias("size"))
    return own.select("event_id", measures.clock(F.col("ts")).alias("clock"), measures.kb_to_bytes(F.col("size")).alias("bytes"), measures.bytes_to_kb(F.col("size") * 100).alias("kb"))


@_query
def progress_bars(spark: SparkSession, sf: str) -> DataFrame:
    share = measures.percent(F.col("p_size"), F.lit(50))
    return table(spark, sf, "part").select("p_partkey", measures.progress_bar(share).alias("bar"))


@_query
def fifo_order(spark: SparkSession, sf: str) -> DataFrame:
    queue = queueing.fifo(fetch_log(spark, sf).select("host", F.col("event_id").alias("ord")))
    return queue.groupBy("host").agg(F.min("ord").alias("head"), F.max("ord").alias("tail"), F.count("*").alias("n"))


@_query
def random_host_choice(spark: SparkSession, sf: str) -> DataFrame:
    return queueing.random_host(_pending(spark, sf), _blocked(spark, sf), 7)


@_query
def refresh_needed(spark: SparkSession, sf: str) -> DataFrame:
    s = queueing.statistics(_pending(spark, sf), _blocked(spark, sf))
    return s.select(queueing.needs_refresh(F.col("available_domains"), F.col("total_domains")).alias("refresh"))


@_query
def job_types(spark: SparkSession, sf: str) -> DataFrame:
    return fetch_log(spark, sf).groupBy("job_type").agg(F.count("*").alias("n")).join(spark.range(3).select(F.col("id").alias("code"), measures.job_type(F.col("id").cast("int")).alias("job_type")), "job_type").select("code", "job_type", "n")


@_query
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.report_lines(_findings(spark, sf), verbose=True).select(F.col("ord").cast("bigint").alias("ord"), "line")


@_query
def deep_refs_full(spark: SparkSession, sf: str) -> DataFrame:
    return refs.references(files(spark, sf), "deep_full").select("page_id", F.col("pos").cast("bigint").alias("pos"), "package")


@_query
def deep_refs_strict(spark: SparkSession, sf: str) -> DataFrame:
    return refs.references(files(spark, sf), "deep_strict").select("page_id", F.col("pos").cast("bigint").alias("pos"), "package")


def _intricate() -> Column:
    """Bodies that only a lexer reads, by p_partkey mod 8: escapes, brackets, templates, regular expressions after a bracket."""
    q, tick, slash = "'", "`", "\\"
    forms = (
        ("require('" + slash + "u0061", q + ")"),
        ("require(('", "'))"),
        ("(require)('", q + ")"),
        (f"x = {tick}${{{tick}}}{tick}}}{tick}; require('", q + ")"),
        ("if (x) /re'/.test(y); require('", q + ")"),
        ("let x = require('" + slash + "x61", slash + "\n" + q + ")"),
        (f"x = {tick}${{require('", f"')}}{tick}"),
        (f"x = {tick}a${{ {{b: {tick}${{", f"}}{tick}}} }}{tick}; f(y) / require('ab') / 2"),
    )
    name = F.regexp_replace("p_name", " ", "-")
    return F.element_at(F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in forms]), (F.col("p_partkey") % 8 + 1).cast("int"))


@_query
def deep_syntax(spark: SparkSession, sf: str) -> DataFrame:
    """What both deep modes read in bodies that one pattern cannot scan."""
    rows = table(spark, sf, "part").select("p_partkey", _intricate().alias("body"))
    modes = [refs.references(rows, m).select("p_partkey", F.lit(m).alias("mode"), "package") for m in ("deep_strict", "deep_full")]
    return modes[0].unionByName(modes[1])


@_query
def unclaimed_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.unclaimed_by_filter(_firsts(spark, sf), registry_log(spark, sf))


@_query
def deep_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose text is no plain script, so that the pattern of regex mode reads them."""
    return files(spark, sf).select("page_id", strict_or_null(F.col("body")).isNull().alias("fallback"))


def _touched(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes an empty file below root for each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = datasource.opened(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store.create_dir(f"{top}/{name}".rpartition("/")[0])
                store.open_output_stream(f"{top}/{name}").close()
            yield batch

    return run


@_query
def listed_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Script files of a folder tree with hidden and mixed-case names, which tasks make of the pages and list again."""
    folder = F.concat(F.lit("d"), F.col("page_id") % 7, F.when(F.col("page_id") % 3 == 0, "/.hid/").when(F.col("page_id") % 3 == 1, "/_pages/").otherwise("/"))
    name = F.concat(F.when(F.col("page_id") % 2 == 0, "_").otherwise("."), F.col("page_id"), F.element_at(F.array(*map(F.lit, (".js", ".TS", ".jsx", ".d.ts"))), (F.col("page_id") % 4 + 1).cast("int")))
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    table(spark, sf, "pages").select(F.concat(folder, name).alias("name")).mapInArrow(_touched(root), "name string").write.format("noop").mode("overwrite").save()
    datasource.make_folder(root)
    found = datasource.folder_targets(spark, root)
    return found.select(F.substring("target", len(datasource.opened(root)[1]) + 2, 1_000_000).alias("target"))


@_query
def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the one report file that tasks write of the findings."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}/report"
    datasource.save_report(_findings(spark, sf), path, "text", verbose=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _stream_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], mode: str, order: tuple[str, ...] = (), last: DataFrame | None = None, keyed: bool = True) -> DataFrame:
    """What the stream puts out; with an order, parts of bounded size follow each other in it."""
    path = _stream_dir(spark)
    parts = streams.in_order(rows, f"{path}/ordered", *order) if order else [rows]
    return streams.replay(parts, path, make, mode, last, keyed)


@_query
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, files(spark, sf), lambda s: streams.new_packages(s).select("package"), "append", keyed=False)


@_query
def stream_rate_state(spark: SparkSession, sf: str) -> DataFrame:
    got = _streamed(spark, fetch_log(spark, sf), lambda s: streams.host_states(s, MAX_RATE), "update", ("ts", "event_id"))
    return got.groupBy("host").agg(F.max_by(F.struct("*"), F.col("sent") + F.col("rejected")).alias("x")).select("x.*")


@_query
def stream_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """All ticks from the first to the last event, as the stream alone puts them out: timers give the idle ones."""
    rows = table(spark, sf, "events").select("event_id", F.timestamp_micros(measures.micros(F.col("ts"))).alias("ts"))
    # The beat closes the last event's tick, and none after it.
    end = rows.agg(F.max(F.floor(F.unix_micros("ts") / 2_000_000))).first()[0]
    last = streams.beat(rows, F.timestamp_seconds(F.lit(2 * ((end or 0) + 1) + 10)))
    return _streamed(spark, rows, streams.ticks, "append", ("ts",), last)


@_query
def stream_first_source(spark: SparkSession, sf: str) -> DataFrame:
    def make(s: DataFrame) -> DataFrame:
        return stream_findings_.first_sources_so_far(refs.references(s).withColumnRenamed("url", "source_url"))

    # Later pages come first, so that most sources are corrected.
    pages = files(spark, sf).withColumn("turn", -F.col("page_id"))
    return stream_findings_.latest_sources(_streamed(spark, pages, make, "update", ("turn",)))


@_query
def stream_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of two streams: files and answers come in over fifty minutes, and answers are waited for an hour."""
    start = F.timestamp_seconds(F.lit(1_704_067_200))
    pages = files(spark, sf).withColumn("ts", start + F.make_dt_interval(secs=F.col("page_id") % 3000))
    answers = registry_log(spark, sf).withColumn("ts", start + F.make_dt_interval(secs=F.pmod(F.crc32("package"), F.lit(3000))))
    path = _stream_dir(spark)
    opened = []
    for rows, name, values in ((pages, "files", {}), (answers, "answers", {"package": "no name"})):
        rows.write.parquet(f"{path}/{name}")
        streams.beat(rows, start + F.make_dt_interval(hours=F.lit(3)), **values).write.parquet(f"{path}/{name}-beat")
        opened.append(streams.file_stream(spark, f"{path}/{name}*", rows.schema))
    found = streams.drain(stream_findings_.findings(*opened), f"{path}/out", f"{path}/state", keyed=False)
    return stream_findings_.latest_sources(found).withColumnRenamed("package", "unclaimed_package")
