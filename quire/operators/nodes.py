"""HTML to rows: a tolerant parse into a node table, and what can be asked of it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
REFERENCE = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([a-z]{2,4}));")


def decode(text: str) -> str:
    """Numeric references and the few names that matter; others stay."""
    def one(m: re.Match) -> str:
        if m.group(3):
            return NAMED.get(m.group(3), m.group())
        code = int(m.group(1)) if m.group(1) else int(m.group(2), 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m.group()

    return REFERENCE.sub(one, text) if "&" in text else text


def body(html: str) -> str:
    m = re.search(r"<body[^>]*>", html, re.I)
    if not m:
        return html
    end = re.search("</body", html[m.end() :], re.I)
    return html[m.end() : m.end() + end.start()] if end else html[m.end() :]


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m.group(1).lower(), decode(value))
    return out


def parse(html: str) -> Iterator[tuple[int, int | None, int, int, str | None, dict | None, str | None]]:
    """node_id, parent_id, depth, ord (among siblings), tag, attrs, text. Text nodes have no tag; what isn't closed ends with the document; an end tag without its start is skipped."""
    stack: list[tuple[int, str]] = []
    children: dict[int | None, int] = {}
    made = at = 0

    def place() -> tuple[int | None, int, int]:
        parent = stack[-1][0] if stack else None
        children[parent] = children.get(parent, -1) + 1
        return parent, len(stack), children[parent]

    while at < len(html):
        m = TAG.search(html, at)
        raw = html[at : m.start() if m else len(html)]
        if raw:
            parent, depth, order = place()
            yield made, parent, depth, order, None, None, decode(raw)
            made += 1
        if not m:
            return
        at = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            names = [t for _, t in stack]
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
            continue
        parent, depth, order = place()
        yield made, parent, depth, order, tag, attributes(m.group(3)), None
        if tag not in VOID and not m.group(3).rstrip().endswith("/"):
            stack.append((made, tag))
        made += 1


def table(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the nodes of each page's body."""
    names = (("node_id", IntegerType()), ("parent_id", IntegerType()), ("depth", IntegerType()), ("ord", IntegerType()), ("tag", StringType()), ("attrs", MapType(StringType(), StringType())), ("text", StringType()))
    schema = StructType([pages.schema[key], *[StructField(n, t) for n, t in names]])
    types = [pa.int32()] * 4 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(parse(body(batch.column(1)[i].as_py() or "")))
                if rows:
                    columns = [pa.array([list(r[k].items()) if k == 5 and r[k] is not None else r[k] for r in rows], t) for k, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *columns], names=[key, *[n for n, _ in names]])

    return pages.select(key, html).mapInArrow(run, schema)


def text_of(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text: all text of a page in document order, white space collapsed; a br is a line feed."""
    piece = F.when(F.col("tag") == "br", "\n").otherwise(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", piece.alias("p")))), lambda x: x["p"]), "")
    return nodes.groupBy(key).agg(F.trim(F.regexp_replace(joined, " *\n *", "\n")).alias("text"))


def raw_text(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, text: all text as it stands, for preformatted parts."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.coalesce("text", F.lit("")).alias("p")))), lambda x: x["p"]), "")
    return nodes.groupBy(key).agg(joined.alias("text"))


def chunk_counts(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    section = (F.col("tag") == "article") & F.array_contains(F.split(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), r"\s+"), "section")
    return nodes.groupBy(key).agg(F.count_if(section).alias("chunks"))


def cells(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, row (its node), col, head, align of each table cell."""
    cell = nodes.where("tag in ('td', 'th')")
    align = F.coalesce(F.try_element_at("attrs", F.lit("align")), F.regexp_extract(F.coalesce(F.try_element_at("attrs", F.lit("class")), F.lit("")), "align-([a-z]+)", 1))
    return cell.select(key, F.col("parent_id").alias("row"), F.col("ord").alias("col"), (F.col("tag") == "th").alias("head"), align.alias("align"))


def problem_lines(messages: Column) -> Column:
    """array<struct<line, text>> of an engine message: the line number it names, if any."""
    return F.transform(F.filter(F.split(messages, "\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.coalesce(F.regexp_extract(x, r"\bline ([0-9]{1,9})", 1).try_cast("int"), F.regexp_extract(x, r":([0-9]{1,9}):", 1).try_cast("int")).alias("line"), x.alias("text")))
