"""Texts to records, paragraphs, lines and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Possessive repeats: a greedy group would recurse once a line.
RECORD = r"(?s)[^\n][^\n]*+(?:\n(?!\n)[^\n]++)*+(?:\n\n|\n?\z)"
LINE = r"[^\n]*\n|[^\n]+"
BLANKS = re.compile(r"[^\S\n]*")

# Marks that end a sentence, and commas.
STOPS = frozenset(".!?;:。！？；：．")
COMMAS = frozenset(",、，")


def records(text: Column) -> Column:
    """Records end at the first line that is empty; leading empty lines are skipped."""
    return F.regexp_extract_all(text, F.lit(RECORD), F.lit(0))


def paragraphs(record: Column) -> Column:
    """The parts between empty lines of either line end; empty ones at the end go, others stay."""
    parts = F.split(record, "\r?\n\r?\n")
    last = F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.slice(parts, 1, last)


def lines(paragraph: Column) -> Column:
    """Lines with their line feeds."""
    return F.regexp_extract_all(paragraph, F.lit(LINE), F.lit(0))


def without_returns(paragraph: Column) -> Column:
    """A paragraph without carriage returns, and without the blanks that stand before one at its end or start."""
    chopped = F.regexp_replace(F.regexp_replace(paragraph, r"[ \t]*\r(?=\n?\z)", ""), r"\A[ \t]*\r", "")
    return F.replace(chopped, F.lit("\r"), F.lit(""))


def indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, "^( *)", 1))


def exploded_records(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(records(F.coalesce("text", F.lit("")))).alias("rec_no", "record"))


def exploded_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, rec_no, para_no, paragraph."""
    own = exploded_records(docs)
    return own.select("doc_id", "rec_no", F.posexplode(paragraphs("record")).alias("para_no", "paragraph"))


def lines_with_indent(paragraph: Column) -> Column:
    """array<struct<line, len, indent>> of a paragraph: len with the line feed; a blank line has the indent of the one before."""
    own = lines(paragraph)
    blank = lambda x: F.trim(F.translate(x, "\t\n\r\f\x0b", "     ")) == ""

    def one(line: Column, i: Column) -> Column:
        before = F.filter(F.slice(own, F.lit(1), i + 1), lambda x: ~blank(x))  # only looked up for blank lines
        return F.struct(line.alias("line"), F.length(line).alias("len"), F.when(~blank(line), indent(line)).when(F.size(before) > 0, indent(F.element_at(before, -1))).otherwise(0).alias("indent"))

    return F.transform(own, one)


def exploded_lines(docs: DataFrame) -> DataFrame:
    """doc_id, rec_no, para_no, line_no, line, len, indent; made inside each paragraph's row."""
    rows = exploded_paragraphs(docs).select("doc_id", "rec_no", "para_no", F.posexplode(lines_with_indent(without_returns(F.col("paragraph")))).alias("line_no", "l"))
    return rows.select("doc_id", "rec_no", "para_no", "line_no", "l.line", "l.len", "l.indent")


def expand_tabs(line: str, width: int) -> str:
    """Tabs to spaces; stops are counted in bytes."""
    while (at := line.find("\t")) >= 0:
        line = line[:at] + " " * (width - len(line[:at].encode()) % width) + line[at + 1 :]
    return line


def split_point(text: str, most: int) -> int:
    """Where to cut a text of over `most` characters: after the last sentence end of the last 200, else after a comma, else at white space, else at most."""
    if len(text) <= most:
        return len(text)
    low, comma = max(0, most - 200), 0
    for i in range(most - 1, low - 1, -1):
        if text[i] in STOPS:
            return i + 1
        if text[i] in COMMAS and not comma:
            comma = i + 1
    if comma:
        return comma
    for i in range(most - 1, low - 1, -1):
        if text[i].isspace():
            return i + 1
    return most


def split_chars(text: str, most: int) -> list[str]:
    """Chunks of at most `most` characters; white space but line feeds goes at the start of each but the first."""
    if not most:
        return [text]
    out, at = [], 0
    while at < len(text):
        piece = text[at : at + most + 1]
        if len(piece) <= most:
            out.append(piece)
            break
        cut = split_point(piece, most)
        out.append(piece[:cut])
        at = BLANKS.match(text, at + cut).end()
    return out


def char_chunks(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, chunk_no from 1, chunk."""
    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_chars(t or "", most))

    return docs.select("doc_id", F.posexplode(split("text")).alias("n", "chunk")).select("doc_id", (F.col("n") + 1).alias("chunk_no"), "chunk")
