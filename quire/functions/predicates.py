"""What a line looks like: Column predicates over raw lines.

Patterns end in (?=\\n?\\z) for "the end or before one last line feed", which Java's $ is not. Repeats that could
recurse over long lines are possessive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

END = r"(?=\n?\z)"

# What a line may do, as bits.
ACTIONS = {"LIST": 1, "HRULE": 2, "PAR": 4, "PRE": 8, "END": 16, "BREAK": 32, "HEADER": 64, "MAILHEADER": 128, "MAILQUOTE": 256, "CAPS": 512, "LINK": 1024, "PRE_EXPLICIT": 2048, "TABLE": 4096, "IND_BREAK": 8192, "LIST_START": 16384, "LIST_ITEM": 32768}
BULLETS = "-=o*·"


def class_body(chars: str) -> str:
    """Characters as the inside of a character class."""
    return "".join("\\" + c if c in "\\]^-[&~" else c for c in chars)


def is_blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\n\r\f\x0b", "     ")) == ""


def is_hrule(line: Column, least: int = 4) -> Column:
    return line.rlike(rf"^\s*+(?:[-_~=*]\s*+){{{least},}}+{END}")


def is_caps(line: Column, least: int = 3) -> Column:
    """A line without small letters that has a run of capitals."""
    return line.rlike(rf"(?s)\A[^a-z<]*\z") & line.rlike(rf"[A-Z]{{{least}}}")


def is_preformatted(line: Column, least: int = 5) -> Column:
    return line.rlike(rf"\s{{{least}}}\S") | line.rlike(rf"\.{{{least}}}\S")


def is_mail_header(line: Column) -> Column:
    return line.rlike(r"\AFrom|Newsgroups: ")


def is_mail_quote(escaped: Column) -> Column:
    """On an escaped line: a quote mark after a word, or a bar or colon first."""
    return escaped.rlike(r"\A(?:\w*+&gt|[|:])")


def list_prefix(line: Column, bullets: str = BULLETS) -> Column:
    """struct(prefix, number, term) of a line that starts a list item; prefix is empty if it doesn't."""
    mark = f"[{class_body(bullets)}]"
    bullet = line.rlike(rf"\A\s*+{mark}\s+\S")
    ordered = line.rlike(r"\A\s*+(?:\d+|[A-Za-z_])[.)\]:]\s+\S")
    term = F.regexp_extract(line, rf"\A\s*+(\w\w+):{END}", 1)
    number = F.regexp_extract(line, r"\A\s*+(\d+|[A-Za-z_])\S\s+\S", 1)
    if "o" in bullets:
        number = F.when(line.rlike(r"\A\s*+o\s"), "").otherwise(number)
    prefix = (
        F.when(~(bullet | ordered | (term != "")), "")
        .when(term != "", F.concat(F.regexp_extract(line, r"\A(\s*)", 1), F.lit(":")))
        .when(number != "", F.concat(F.regexp_extract(line, r"\A(\s*)", 1), F.regexp_extract(line, r"\A\s*+(?:\d+|[A-Za-z_])(.)", 1)))
        .otherwise(F.regexp_extract(line, rf"(?s)\A(\s*{mark}.)", 1))
    )
    started = bullet | ordered | (term != "")
    return F.struct(prefix.alias("prefix"), F.when(started, number).otherwise("").alias("number"), F.when(started, term).otherwise("").alias("term"))


def is_bullet_line(line: Column, bullets: str = BULLETS) -> Column:
    found = list_prefix(line, bullets)
    return (found["prefix"] != "") & (found["number"] == "")


def total_prefix(line: Column, bullets: str = BULLETS) -> Column:
    """The whole width a marker takes: spaces, marker, one character, spaces."""
    return F.regexp_extract(line, rf"(?s)\A(\s*[\w{class_body(bullets)}]*.?\s*)", 1)


def is_underline(line: Column) -> Column:
    return line.rlike(rf"\A\s*+[-=*.~+]++\s*+\z")


def is_heading(line: Column, after: Column, length_tolerance: int = 1, offset_tolerance: int = 1) -> Column:
    """A line over an underline: about as long, or about as far in. Entities count as one character."""
    def offset(c: Column) -> Column:
        return F.length(F.regexp_extract(c, r"\A(\s*)", 1))

    text = F.regexp_replace(F.regexp_replace(line, r"\A\s+", ""), "&[^;]+;", "X")  # the line feed counts
    near = F.abs(F.length(text) - F.length(F.regexp_extract(after, r"(\S+)", 1))) <= length_tolerance
    flush = F.abs(offset(line) - offset(after)) <= offset_tolerance
    return ~is_blank(line) & ~is_bullet_line(line) & F.coalesce(is_underline(after), F.lit(False)) & (near | flush)


def is_custom_heading(line: Column, patterns: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in patterns:
        test = test | line.rlike(p)
    return test


def is_pgsql_table(rows: Column) -> Column:
    """Rows of a query result: an optional caption, names, a rule, values, a count of rows."""
    body = F.when(~F.contains(rows[0], F.lit("|")) & rows[0].rlike(r"\A\s*+\w"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    at = lambda i: F.get(body, F.lit(i))
    return F.coalesce((F.size(body) >= 4) & at(0).rlike(r"\A\s*+\w++\s++\|\s") & at(1).rlike(r"\A\s*+-++\+-") & at(2).rlike(r"\A\s*+[^|]*\s\|\s") & F.element_at(body, -1).rlike(r"\(\d+\s+rows\)"), F.lit(False))


def is_border_table(rows: Column) -> Column:
    rule = rf"\A\s*+\+-++\+-++\+[-+]*+{END}"
    body = F.when(~F.contains(rows[0], F.lit("|")) & rows[0].rlike(r"\A\s*+\w"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    at = lambda i: F.get(body, F.lit(i))
    return F.coalesce((F.size(body) >= 5) & at(0).rlike(rule) & at(1).rlike(rf"\A\s*+\|\s*+\w++\s++\|\s.*\|{END}") & at(2).rlike(rule) & at(3).rlike(rf"\A\s*+\|\s*[^|]*\s\|\s.*\|{END}") & F.element_at(body, -1).rlike(rule), F.lit(False))


def delimiter(row: Column) -> Column:
    """The first sign of a row, if it may part cells."""
    found = F.regexp_extract(row, r"\A\s*([^A-Za-z0-9])", 1)
    return F.when((found != "") & ~found.isin("^", "[", "]", "\\"), found)


def is_delim_table(rows: Column) -> Column:
    """Every row starts and ends with one sign and has it equally often, three times at least."""
    body = F.when(~rows[0].rlike(r"[^\w\s]") & rows[0].rlike(r"\A\s*+\w"), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    first = F.get(body, F.lit(0))
    sign = delimiter(first)
    count = lambda row: F.length(row) - F.length(F.replace(row, sign, F.lit("")))
    bare = lambda row: F.trim(F.translate(row, "\t\n\r\f\x0b", "     "))
    regular = F.forall(body, lambda r: F.startswith(bare(r), sign) & F.endswith(bare(r), sign) & (count(r) == count(first)))
    return F.coalesce((F.size(body) >= 2) & sign.isNotNull() & (count(first) >= 3) & regular, F.lit(False))


def table_kind(rows: Column, aligned: Column, kinds: tuple[str, ...] = ("delim", "align", "pgsql", "border")) -> Column:
    """DELIM, ALIGN, PGSQL, BORDER or none, the first that fits; aligned says whether columns line up."""
    tests = {"delim": is_delim_table(rows), "align": aligned, "pgsql": is_pgsql_table(rows), "border": is_border_table(rows)}
    found = F.when(F.size(rows) < 2, F.lit(None).cast("string"))
    for k in ("delim", "align", "pgsql", "border"):
        if k in kinds:
            found = found.when(tests[k], k.upper())
    return found


def without(modes: Column, mask: int) -> Column:
    """The bits of modes that mask doesn't have."""
    return modes.bitwiseAND(F.bitwise_not(F.lit(mask)))


def unhyphenated(text: Column) -> Column:
    """A word cut by a hyphen at a line's end is put together on the first line."""
    return F.regexp_replace(text, r"(\s*)([A-Za-z]*)-\n(\s*)([A-Za-z]+['\").,:;}>]*\s*)", "$1$2$4\n$3")


def literal(text: str) -> str:
    return re.escape(text)
