"""Templates, versions and names as Column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "quire"
# The slots a template may have, beside var:NAME.
SLOTS = ("title", "head", "header", "toc", "body", "citations", "glossary", "lang", "notes")


def fill(template: Column, slots: Column, namespace: str = NAMESPACE) -> Column:
    """Each {{namespace:name}} replaced by slots[name] in one pass; unknown ones stay, and values are not read again."""
    opening = re.escape("{{" + namespace + ":")
    parts = F.regexp_extract_all(template, F.lit(rf"(?s){opening}[^}}]*+\}}\}}|.[^{{]*+"), F.lit(0))
    name = lambda p: F.regexp_extract(p, rf"(?s)\A{opening}([^}}]*)\}}\}}\z", 1)
    return F.array_join(F.transform(parts, lambda p: F.when(name(p) != "", F.coalesce(F.try_element_at(slots, name(p)), p)).otherwise(p)), "")


def slots_used(template: Column, namespace: str = NAMESPACE) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(re.escape("{{" + namespace + ":") + r"([^}]*)\}\}"), F.lit(1)))


def unknown_slots(template: Column, declared: Column, namespace: str = NAMESPACE) -> Column:
    """Slots that are neither known nor declared variables."""
    return F.array_sort(F.array_except(slots_used(template, namespace), F.concat(F.array(*map(F.lit, SLOTS)), F.transform(declared, lambda v: F.concat(F.lit("var:"), v)))))


def unused_variables(template: Column, declared: Column, namespace: str = NAMESPACE) -> Column:
    return F.array_sort(F.array_except(F.transform(declared, lambda v: F.concat(F.lit("var:"), v)), slots_used(template, namespace)))


def version_parts(version: Column) -> Column:
    """[major, minor, patch], missing parts 0."""
    parts = F.transform(F.slice(F.split(F.regexp_replace(version, r"[-+].*\z", ""), r"\."), 1, 3), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0))), 1, 3)


def version_satisfies(have: Column, least: Column) -> Column:
    """Arrays compare part by part."""
    return version_parts(have) >= version_parts(least)


def is_semver(version: Column) -> Column:
    part = r"(?:0|[1-9][0-9]*)"
    return version.rlike(rf"\A{part}\.{part}\.{part}(?:-(?:{part}|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:{part}|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\z")


def is_reverse_dns(name: Column) -> Column:
    return name.rlike(r"\A[a-z][a-z0-9-]*(?:\.[a-z0-9][a-z0-9-]*)+\z")


def is_note_key(key: Column) -> Column:
    return key.rlike(r"\A[A-Za-z0-9._-]+\z")


def is_safe_path(path: Column) -> Column:
    """A relative path that stays below its root."""
    return ~path.rlike(r"\A/|\A[A-Za-z]:|\\|\x00|(?:\A|/)\.\.(?:/|\z)") & (path != "")


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def fuzzy(text: Column, query: str) -> Column:
    """Whether the query's characters occur in the text in order, in any case."""
    return F.lower(text).rlike("(?s)" + ".*?".join(map(re.escape, query.lower())))


def line_col(text: Column, index: Column) -> Column:
    """struct(line, col), from 1, of a character index."""
    before = F.substr(text, F.lit(1), index)
    return F.struct((F.regexp_count(before, F.lit("\n")) + 1).cast("long").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long").alias("col"))


def find_in_source(source: Column, heading: Column) -> Column:
    """Where a heading's text first stands in the source, from 1; 0 if it doesn't."""
    return F.instr(source, heading)


def declared_slots(templates, template: str = "html"):
    """The slots that any of the templates uses, each once."""
    return templates.select(F.explode(slots_used(F.col(template))).alias("slot")).distinct().orderBy("slot")
