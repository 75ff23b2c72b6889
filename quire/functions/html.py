"""HTML as text: counts, headings, outline, body, entities; Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def counts(html: Column) -> dict[str, Column]:
    """bytes, headings, paragraphs, strong, br of rendered HTML; any case, by the start of the tag."""
    n = lambda pattern: F.regexp_count(html, F.lit(pattern)).cast("long")
    return {
        "bytes": F.octet_length(html).cast("long"),
        "headings": n("(?i)<h[1-6]"),
        "paragraphs": n(r"(?i)<p[>\s]"),
        "strong": n("(?i)<strong"),
        "br": n("(?i)<br"),
    }


def report_line(counted: dict[str, Column]) -> Column:
    return F.format_string("%d bytes, %d headings, %d paragraphs, %d capitals, %d breaks", *(counted[k] for k in ("bytes", "headings", "paragraphs", "strong", "br")))


def heading_level(line: Column) -> Column:
    """1 to 6 for a line that is one whole heading, null otherwise."""
    found = F.regexp_extract(line, r"(?i)\A<h([1-6])>.*</h\1>[\r \t]*\n?\z", 1)
    return F.when(found != "", found.cast("int"))


def heading_body(line: Column) -> Column:
    return F.regexp_extract(line, r"(?i)\A<h([1-6])>(.*)</h\1>[\r \t]*\n?\z", 2)


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, "<[^>]*>", ""))


def body(html: Column) -> Column:
    """What stands in the body element; all of a text that has none."""
    return F.when(html.rlike("(?i)<body"), F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body|\z)", 1)).otherwise(html)


def decoded(text: Column) -> Column:
    """The named references amp, lt, gt, quot, apos and nbsp as characters."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def outline(html: Column) -> Column:
    """array<struct<level, attrs, inner>> of the headings, in document order."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>"), F.lit(0))
    return F.transform(
        whole,
        lambda h: F.struct(
            F.regexp_extract(h, r"(?i)\A<h([1-6])", 1).cast("int").alias("level"), F.regexp_extract(h, r"(?is)\A<h[1-6]([^>]*)>", 1).alias("attrs"), F.regexp_extract(h, r"(?is)\A<h[1-6][^>]*>(.*)</h[1-6]>\z", 1).alias("inner")
        ),
    )


def anchor(attrs: Column, inner: Column) -> Column:
    """Where a heading can be linked to: its own id, a named anchor inside, or the target of a link inside; empty if none."""
    quoted = lambda c, key: F.regexp_extract(c, rf"(?i)\b{key}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(quoted(attrs, "id") != "", quoted(attrs, "id")).when(quoted(inner, "name") != "", quoted(inner, "name")).otherwise(F.regexp_extract(inner, r"(?i)\bhref\s*=\s*[\"']#([^\"']*)[\"']", 1))


def has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(F.split(F.regexp_extract(attrs, r"(?i)\bclass\s*=\s*[\"']([^\"']*)[\"']", 1), r"\s+"), name)
