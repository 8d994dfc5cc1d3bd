"""Tables about proxies and request headers. No query opens a connection; probe results are input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.functions.measures import header_parts
from claimlens.functions.urls import proxy_url
from claimlens.sources.targets import lines, literal


def proxy_strings(spark: SparkSession, proxy: str | None = None, proxy_file: str | None = None) -> DataFrame:
    """(target_ord, proxy) of one proxy or a list file; both at once is an error."""
    if proxy and proxy_file:
        raise ValueError("give one proxy or a proxy file, not both")
    found = lines(spark, proxy_file) if proxy_file else literal(spark, [proxy] if proxy else [])
    return found.withColumnRenamed("target", "proxy")


def parsed_proxies(proxies: DataFrame) -> DataFrame:
    """With url; what is no proxy is left out."""
    return proxies.withColumn("url", proxy_url(F.col("proxy"))).where("url is not null")


def live_proxies(probes: DataFrame) -> DataFrame:
    """Proxies whose probe (url, status, error) answered 204; ValueError if there is none."""
    live = probes.where((F.col("status") == 204) & F.col("error").isNull())
    if not live.limit(1).count():
        raise ValueError("no live proxy")
    return live


def header_map(headers: Column, agent: str | None = None, own: Column | None = None) -> Column:
    """A map of `Name: value` texts in order: the agent first, the texts next, a request's own map last; the last wins."""

    def pair(h: Column) -> Column:
        name, value = header_parts(h)
        return F.struct(name.alias("key"), value.alias("value"))

    pairs = F.filter(F.transform(headers, pair), lambda p: p["key"].isNotNull())
    if agent is not None:
        pairs = F.concat(F.array(F.struct(F.lit("User-Agent").alias("key"), F.lit(agent).alias("value"))), pairs)
    if own is not None:
        pairs = F.concat(pairs, F.map_entries(own))
    # Only the last entry of each name stays, whatever the session says of repeated keys. One pass names the pairs once: what a lambda names is made anew for each element.
    none = F.array().cast("array<struct<key:string,value:string>>")
    last = F.aggregate(pairs, none, lambda kept, p: F.concat(F.filter(kept, lambda k: k["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(last)
