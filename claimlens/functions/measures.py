"""Backoff, rates, progress, sizes, headers and report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INITIAL_RATE, BURST = 2.0, 2
RAISE, CUT, FLOOR = 0.2, 0.7, 0.1
MOST_BACKOFF, EVICTION = 60, 5
JOB_TYPES = ("FetchJS", "ProcessJS", "VerifyPackage")
BAR = 40


def backoff_seconds(rejections: Column) -> Column:
    """4, 8, 16, 32, then 60 for the first, second, ... rejection of a host; the exponent is capped."""
    return F.least(F.pow(F.lit(2.0), F.least(rejections, F.lit(30)) + 1), F.lit(float(MOST_BACKOFF))).cast("bigint")


def raised(rate: Column, most: float) -> Column:
    return F.least(rate + F.lit(RAISE), F.lit(float(most)))


def cut(rate: Column) -> Column:
    return F.greatest(rate * F.lit(CUT), F.lit(FLOOR))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    whole = (days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000
    return whole + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def percent(current: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(current.cast("double") / total * 100)


def progress_bar(share: Column) -> Column:
    filled = F.floor(share / 100 * BAR).cast("int")
    return F.rpad(F.repeat(F.lit("█"), filled), BAR, " ")


def eta(current: Column, total: Column, elapsed_s: Column) -> Column:
    """The remaining time at the speed so far, in words."""
    left = F.floor(elapsed_s / current * (total - current)).cast("bigint")
    text = F.when(left < 60, F.concat(left.cast("string"), F.lit("s")))
    text = text.when(left < 3600, F.concat(F.floor(left / 60).cast("string"), F.lit("m"), (left % 60).cast("string"), F.lit("s")))
    text = text.otherwise(F.concat(F.floor(left / 3600).cast("string"), F.lit("h"), F.floor(left % 3600 / 60).cast("string"), F.lit("m")))
    return F.when((current == 0) | (elapsed_s < 1), F.lit("calculating...")).when((total <= current) | (left <= 0), F.lit("done")).otherwise(text)


def job_type(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, JOB_TYPES)), code + 1)


def header_parts(header: Column) -> tuple[Column, Column]:
    """Name and value of `Name: value`, split at the first colon; null without one."""
    at = F.instr(header, ":")
    name, value = F.substr(header, F.lit(1), at - 1), F.substr(header, at + 1)
    return F.when(at > 0, F.trim(name)), F.when(at > 0, F.trim(value))


def kb_to_bytes(kb: Column) -> Column:
    return kb * 1024


def bytes_to_kb(size: Column) -> Column:
    return F.floor(size / 1024).cast("bigint")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two moments in microseconds, halves rounded away from zero."""
    return F.round((end - start) / 1_000_000.0).cast("bigint")


# The wording of settings and reports.


def settings_line(rate: Column, max_kb: Column, no_limit: Column, deep: Column, tls_unchecked: Column, headers: Column, proxies: Column, proxy_asked: Column) -> Column:
    """The settings in one line; parts that do not apply are left out. A proxy that was asked for may be none when no probe lived."""
    parts = F.concat_ws(
        ", ",
        F.format_string("Rate Limit: Auto (Max %s/s)", rate.cast("string")),
        F.when(no_limit, F.lit("File Size Limit: Disabled")).otherwise(F.format_string("File Size Limit: %s KB", max_kb.cast("string"))),
        F.when(deep, F.lit("Deep Scan: Enabled")),
        F.when(tls_unchecked, F.lit("TLS Verification: Disabled")),
        F.when(headers > 0, F.format_string("Custom Headers: %s", headers.cast("string"))),
        F.when(proxies > 0, F.format_string("Using %s Live Proxies", proxies.cast("string"))).when(proxy_asked, F.lit("Proxy: None (check failed)")),
    )
    return F.concat(F.lit("Settings: "), parts)


REPORT_HEAD, REPORT_PACKAGE, REPORT_SOURCE = "Found %d unclaimed dependencies:", "  [+] Package: %s", "      Source:  %s"


def report_line(package: Column, source: Column, verbose: bool = False) -> Column:
    """A finding's line, and its source on a second one if verbose."""
    return F.format_string(f"{REPORT_PACKAGE}\n{REPORT_SOURCE}", package, source) if verbose else F.format_string(REPORT_PACKAGE, package)


def duration(seconds: float) -> str:
    """Rounded to seconds and split, such as 1h0m5s, 2m0s or 7s; halves go up."""
    whole = int(seconds + 0.5)
    h, m, s = whole // 3600, whole // 60 % 60, whole % 60
    return (f"{h}h" if h else "") + (f"{m}m" if h or m else "") + f"{s}s"
