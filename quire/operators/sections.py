"""Finished HTML to sections, numbers, contents, pages and pagers.

Bodies become a table of lines; everything else is windows over it, one document a partition of rows. The string
forms below the DataFrame forms serve one document at a time and are checked against them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import html as H
from quire.operators.records import lines

HEADING = re.compile(r"<h([1-6])>(.*)</h\1>[\r \t]*\Z", re.I | re.S)


def headings(bodies: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """key, line_no, line, level (null for other lines), section: 0 before the first heading, then 1, 2, ..."""
    rows = bodies.select(key, F.posexplode(lines(F.col(html))).alias("line_no", "line")).withColumn("level", H.heading_level(F.col("line")))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.count("level").over(order).cast("int"))


def joined(value: Column, order: str) -> Column:
    """Texts of a group in an order, as an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), "")


def sections(bodies: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """key, ord, level, id, label, html of each section; ord 0 is what stands before the first."""
    rows = headings(bodies, key, html)
    grouped = rows.groupBy(key, F.col("section").alias("ord")).agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), H.without_tags(H.heading_body(F.col("line"))))).alias("label"), joined(F.col("line"), "line_no").alias("html"))
    return grouped.select(key, "ord", "level", F.when(F.col("ord") > 0, F.format_string("chunk-%d", "ord")).alias("id"), F.coalesce("label", F.lit("")).alias("label"), "html")


def numbers(levels: DataFrame, key: str = "doc_id", ord: str = "ord", level: str = "level") -> DataFrame:
    """levels with number: 1, 1.1, ... At each level, headings count since the last one further up."""
    order = Window.partitionBy(key).orderBy(ord).rowsBetween(Window.unboundedPreceding, 0)
    out = levels
    for n in range(1, 7):
        out = out.withColumn(f"__up{n}", F.count_if(F.col(level) < n).over(order))
    for n in range(1, 7):
        inside = Window.partitionBy(key, f"__up{n}").orderBy(ord).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"__n{n}", F.count_if(F.col(level) == n).over(inside))
    parts = F.array(*[F.when((F.lit(n) <= F.col(level)) & (F.col(f"__n{n}") > 0), F.col(f"__n{n}").cast("string")) for n in range(1, 7)])
    return out.withColumn("number", F.array_join(F.filter(parts, lambda x: x.isNotNull()), ".")).drop(*[f"__{k}{n}" for k in ("up", "n") for n in range(1, 7)])


def toc_item(level: Column, target: Column, label: Column) -> Column:
    return F.concat(F.lit('<li class="toc-h'), level.cast("string"), F.lit('"><a href="'), target, F.lit('">'), label, F.lit("</a></li>\n"))


TOC = ('<nav class="toc" id="toc">\n<ol class="toc-list">\n', "</ol>\n</nav>\n")


def contents(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, toc of documents that have headings."""
    item = toc_item(F.col("level"), F.concat(F.lit("#"), "id"), F.col("label"))
    return parts.where("ord > 0").groupBy(key).agg(F.concat(F.lit(TOC[0]), joined(item, "ord"), F.lit(TOC[1])).alias("toc"))


def article(id: Column, html: Column) -> Column:
    return F.concat(F.lit('<article class="section" id="'), id, F.lit('">\n'), html, F.when(F.endswith(html, F.lit("\n")), "").otherwise("\n"), F.lit("</article>\n"))


def sectioned(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, html with each section in an article."""
    return parts.groupBy(key).agg(joined(F.when(F.col("ord") > 0, article(F.col("id"), F.col("html"))).otherwise(F.col("html")), "ord").alias("html"))


def basename(stem: Column, n: Column) -> Column:
    return F.format_string("%s-chunk-%02d.html", stem, n)


def pages(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page_no from 1, id, label, level, html: a page for each heading of the shallowest level; what comes before goes to the first."""
    whole = Window.partitionBy(key)
    top = F.min("level").over(whole)
    run = whole.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("top", top).withColumn("page_no", F.greatest(F.count_if(F.col("level") == F.col("top")).over(run), F.lit(1)).cast("int"))
    first = F.col("level") == F.col("top")
    return rows.groupBy(key, "page_no").agg(F.max(F.when(first, F.col("id"))).alias("id"), F.max(F.when(first, F.col("label"))).alias("label"), F.max("top").alias("level"), joined(F.col("html"), "ord").alias("html"))


def with_pager(paged: DataFrame, stem: Column, key: str = "doc_id") -> DataFrame:
    """Pages with name and pager: links to the page before and the page after."""
    order = Window.partitionBy(key).orderBy("page_no")
    named = paged.withColumn("name", basename(stem, F.col("page_no")))
    named = named.withColumns({"before": F.lag("name").over(order), "after": F.lead("name").over(order)})
    link = lambda name, rel, text: F.when(name.isNotNull(), F.concat(F.lit('<a href="'), name, F.lit(f'" rel="{rel}">'), text, F.lit("</a>\n"))).otherwise("")
    pager = F.concat(
        F.lit('<nav class="pager" aria-label="Parts">\n'),
        link(F.col("before"), "prev", F.concat(F.lit("&#8592; part "), (F.col("page_no") - 1).cast("string"))),
        link(F.col("after"), "next", F.concat(F.lit("part "), (F.col("page_no") + 1).cast("string"), F.lit(" &#8594;"))),
        F.lit("</nav>\n"),
    )
    return named.withColumn("pager", pager).drop("before", "after")


def page_contents(paged: DataFrame, stem: Column, key: str = "doc_id") -> DataFrame:
    """key, toc across pages."""
    target = F.concat(basename(stem, F.col("page_no")), F.coalesce(F.concat(F.lit("#"), "id"), F.lit("")))
    item = toc_item(F.col("level"), target, F.col("label"))
    return paged.where("id is not null").groupBy(key).agg(F.concat(F.lit(TOC[0]), joined(item, "page_no"), F.lit(TOC[1])).alias("toc"))


def heading_levels(titles: DataFrame, key: str = "doc_id", ord: str = "ord", style: str = "style") -> DataFrame:
    """titles with level: styles ranked by where they are first met."""
    first = F.min(ord).over(Window.partitionBy(key, style))
    return titles.withColumn("__first", first).withColumn("level", F.dense_rank().over(Window.partitionBy(key).orderBy("__first")).cast("int")).drop("__first")


# One document --------------------------------------------------------------------------------------------------


def bare(html: str) -> str:
    """Text outside of tags; an open sign inside a tag opens another."""
    out, depth = [], 0
    for c in html:
        if c == "<":
            depth += 1
        elif c == ">":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(c)
    return "".join(out).strip()


def split(body: str) -> tuple[str, list[dict]]:
    """(what stands before the first heading, sections)."""
    before, found = [], []
    for line in body.splitlines(keepends=True) if "\r" not in body and "\x0b" not in body else re.findall(r"[^\n]*\n|[^\n]+", body):
        m = HEADING.match(line.removesuffix("\n"))
        if m:
            found.append({"level": int(m.group(1)), "id": f"chunk-{len(found) + 1}", "label": bare(m.group(2)), "html": line})
        elif found:
            found[-1]["html"] += line
        else:
            before.append(line)
    return "".join(before), found


def number(body: str) -> str:
    """Headings with their numbers in front."""
    counts: dict[int, int] = {}
    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", body):
        m = HEADING.match(line.removesuffix("\n"))
        if m:
            level = int(m.group(1))
            counts = {k: n for k, n in counts.items() if k <= level}
            counts[level] = counts.get(level, 0) + 1
            line = f"{line[:4]}{'.'.join(str(counts[k]) for k in sorted(counts))} {line[4:]}"
        out.append(line)
    return "".join(out)


def toc(found: list[dict]) -> str:
    return TOC[0] + "".join(f'<li class="toc-h{s["level"]}"><a href="{s.get("target", "#" + s["id"])}">{s["label"]}</a></li>\n' for s in found) + TOC[1]


def wrapped(id: str, html: str) -> str:
    return f'<article class="section" id="{id}">\n{html}' + ("" if html.endswith("\n") else "\n") + "</article>\n"


def sectionize(body: str, with_toc: bool) -> tuple[str, str]:
    """(contents, body in articles); a body without headings stays as it is."""
    before, found = split(body)
    if not found:
        return "", body
    return toc(found) if with_toc else "", before + "".join(wrapped(s["id"], s["html"]) for s in found)


def wrap_parts(parts: list[str], with_toc: bool) -> tuple[str, str]:
    found = [{"level": 1, "id": f"chunk-{i}", "label": f"Part {i}", "html": p} for i, p in enumerate(parts, 1)]
    return toc(found) if with_toc else "", "".join(wrapped(s["id"], s["html"]) for s in found)


def paged(start: str, body: str, tail: str, stem: str, section: bool = False, with_toc: bool = False) -> list[tuple[str, str]]:
    """(name, html) of each page of a document."""
    before, found = split(body)
    name = lambda n: f"{stem}-chunk-{n:02d}.html"
    if not found:
        return [(name(1), start + body + tail)]
    top = min(s["level"] for s in found)
    out: list[dict] = [{"id": "", "html": before}]
    for s in found:
        if s["level"] == top:
            if out[-1]["id"]:
                out.append({"id": "", "html": ""})
            out[-1]["id"], out[-1]["label"], out[-1]["level"] = s["id"], s["label"], top
        out[-1]["html"] += s["html"]
    links = toc([p | {"target": f"{name(i)}#{p['id']}"} for i, p in enumerate(out, 1)]) if with_toc else ""
    done = []
    for i, p in enumerate(out, 1):
        back = f'<a href="{name(i - 1)}" rel="prev">&#8592; part {i - 1}</a>\n' if i > 1 else ""
        on = f'<a href="{name(i + 1)}" rel="next">part {i + 1} &#8594;</a>\n' if i < len(out) else ""
        html = wrapped(p["id"], p["html"]) if section or with_toc else p["html"]
        done.append((name(i), f'{start}{links}{html}<nav class="pager" aria-label="Parts">\n{back}{on}</nav>\n{tail}'))
    return done
