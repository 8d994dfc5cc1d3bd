"""Hosts and addresses of targets, registries and proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A remote target, and the host inside one (IPv6 in group 1, else group 2).
REMOTE = r"^https?://"
HOST = r"^https?://(?:[^/?#@]*@)?(?:\[([^\]]*)\]|([^/:?#]*))"
BASE = r"^([a-zA-Z][a-zA-Z0-9+.-]*://)(?:[^/?#@]*@)?([^/?#]*)"
REGISTRY = "https://registry.npmjs.org/"


def is_remote(target: Column) -> Column:
    return target.rlike(REMOTE)


def host(url: Column) -> Column:
    """The host without user, port and brackets; null where there is none."""
    six, plain = F.regexp_extract(url, HOST, 1), F.regexp_extract(url, HOST, 2)
    return F.nullif(F.coalesce(F.nullif(six, F.lit("")), plain), F.lit(""))


def host_with_default_scheme(url: Column) -> Column:
    """As `host`, for text without a scheme too: what does not begin with http gets http://."""
    return host(F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("http://"), url)))


def base_url(url: Column) -> Column:
    """Scheme and host with port, without user; empty without a scheme."""
    return F.concat(F.regexp_extract(url, BASE, 1), F.regexp_extract(url, BASE, 2))


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def registry_url(package: Column, base: str = REGISTRY) -> Column:
    """The registry's address of a package: the name as one escaped path segment."""
    escaped = F.url_encode(package)
    for form, path in (("+", "%20"), ("%40", "@"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3D", "="), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")):
        escaped = F.replace(escaped, F.lit(form), F.lit(path))
    return F.concat(F.lit(base), escaped)


def proxy_url(text: Column) -> Column:
    """`scheme://...` as it is, `host:port` and `host:port:user:password` as http addresses, else null."""
    parts = F.split(text, ":")
    at = [F.get(parts, F.lit(i)) for i in range(4)]
    short = F.concat(F.lit("http://"), at[0], F.lit(":"), at[1])
    full = F.concat(F.lit("http://"), at[2], F.lit(":"), at[3], F.lit("@"), at[0], F.lit(":"), at[1])
    return F.when(F.contains(text, F.lit("://")), text).when(F.size(parts) == 2, short).when(F.size(parts) == 4, full)
