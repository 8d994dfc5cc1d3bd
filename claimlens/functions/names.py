"""Package names: the reference pattern, normalisation, and which names are worth a registry lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the language of regex mode, with white space spelled out so that all engines agree on it.
REFERENCE = (
    r"(?:require[\t\n\f\r ]*\([\t\n\f\r ]*|import[\"'a-zA-Z0-9\t\n\f\r {},*]+from[\t\n\f\r ]+)"
    r"['\"\x60]((?:@[a-z0-9_.-]+\/)?[a-z0-9_.-]+)['\"\x60]"
)
_BLANK = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def regex_references(body: Column) -> Column:
    """All names that regex mode finds in a body, in order."""
    return F.regexp_extract_all(body, F.lit(REFERENCE), F.lit(1))


def trimmed(text: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(text, f"^[{_BLANK}]+|[{_BLANK}]+$", "")


def normalized(name: Column) -> Column:
    """The package of a specifier: `@scope/name/...` keeps two segments, others one."""
    name = trimmed(name)
    return F.when(name.startswith("@"), F.substring_index(name, "/", 2)).otherwise(F.substring_index(name, "/", 1))


def worth_checking(name: Column) -> Column:
    """Neither relative nor absolute, and of two bytes at least."""
    return ~F.substring(name, 1, 1).isin(".", "/", "\\") & (F.octet_length(name) >= 2)
