"""URL policy as Column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REFUSED = ("javascript", "data", "vbscript", "file")
EXTERNAL = ("http", "https", "ftp", "ftps")


def scheme_of(url: Column) -> Column:
    """The scheme as a browser reads it: leading controls and spaces skipped, tabs and line ends dropped; null if none."""
    bare = F.translate(F.regexp_replace(url, r"^[\x00-\x20\x7f]+", ""), "\t\n\r", "")
    found = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.when(found != "", F.lower(found))


def strict_policy(schemes: Iterable[str]) -> tuple[str, ...]:
    """The allowed schemes in order, each once; none stands for the default policy."""
    return tuple(sorted({s.strip().lower() for s in schemes if s.strip()}))


def allowed(url: Column, policy: tuple[str, ...] = ()) -> Column:
    """Whether the policy lets the URL be a link: all but the refused schemes, or only those of a strict policy. No scheme is relative and allowed."""
    scheme = scheme_of(url)
    return scheme.isNull() | (scheme.isin(*policy) if policy else ~scheme.isin(*REFUSED))


def is_external(url: Column) -> Column:
    return F.coalesce(scheme_of(url).isin(*EXTERNAL), F.lit(False))


def describe(policy: tuple[str, ...] = ()) -> str:
    return f"only {', '.join(policy)}" if policy else f"all but {', '.join(REFUSED)}"


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)\s{name}\s*=")


def hrefs(html: Column) -> Column:
    """The href of each anchor, in order."""
    return F.regexp_extract_all(html, F.lit(r"<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*\"([^\">]*)\""), F.lit(1))


def with_rel(anchor: Column) -> Column:
    """rel="nofollow noreferrer" in an anchor's open tag that has none and leads outside."""
    url = F.regexp_extract(anchor, r"(?i)href\s*=\s*\"([^\"]*)\"", 1)
    return F.when(is_external(url) & ~has_attr(anchor, "rel"), F.regexp_replace(anchor, r"^(<[aA])", '$1 rel="nofollow noreferrer"')).otherwise(anchor)
