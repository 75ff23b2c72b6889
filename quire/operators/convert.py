"""Documents to HTML on a cluster: one row a document through the state machine, errors beside the results."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from quire.operators import links, machine, notes, scripts, sections
from quire.operators.records import split_chars
from quire.options import ConvertOptions, check, settled, variables


def load_rules(options: ConvertOptions, dictionaries: Iterable[str] = (), last: Iterable[str] = ()) -> list[links.Rule]:
    """The options' link rules; none if links are off. The dictionaries go before the built-in rules, the last ones after them."""
    if not options.make_links:
        return []
    policy = tuple(sorted({s.strip().lower() for s in (options.allowed_url_schemes or "").split(",") if s.strip()}))
    return links.load_rules(dictionaries, policy, options.lower_case_tags, last=last)[0]


def side_texts(options: ConvertOptions) -> dict[str, str]:
    """The files that go around every document, read once on the driver."""
    from quire.sources.files import side_text

    return {name: side_text(path, options.encoding) for name in ("append_head", "prepend_file", "append_file") if (path := getattr(options, name))}


def document(text: str, options: ConvertOptions, rules: list[links.Rule], template: str = "", whole: bool = False, sides: dict[str, str] | None = None) -> dict[str, str | None]:
    """html, title and error of one document, with all passes that the options ask for."""
    if options.section_chars:
        writer = machine.Writer(options, rules)
        around = sides or {}
        start, parts = writer.start(text, around.get("append_head", ""), around.get("prepend_file", "")), []
        chunks = split_chars(text, options.section_chars)
        for i, c in enumerate(chunks):
            part = "".join(writer.record(r) for r in machine.records(c))
            parts.append(part + (writer.finish() + around.get("append_file", "") if i + 1 == len(chunks) else ""))
        got = {"start": start, "title": writer.title, "head": writer.head, "tail": writer.tail()}
        toc, body = sections.wrap_parts([sections.number(p) if options.number_headings else p for p in parts], options.toc)
    else:
        got = machine.to_html(text, options, rules, whole, sides)
        body, toc = got["body"], ""
        if options.number_headings:
            body = sections.number(body)
        if options.section or options.toc:
            toc, body = sections.sectionize(body, options.toc)
    listed = {"cite": "", "gloss": ""}
    kinds = tuple(k for k, on in (("cite", options.citations), ("gloss", options.glossary)) if on)
    if kinds:
        body, found, wrong = notes.collect(body, kinds)
        if wrong:
            return {"html": None, "title": got["title"], "error": "; ".join(wrong)}
        listed = {k: notes.render(k, found[k]) for k in listed}
    header = f'<header class="document-header">\n<h1>{got["title"]}</h1>\n</header>\n' if got["title"] else ""
    if template:
        body += "".join(listed[k] for k, slot in (("cite", "citations"), ("gloss", "glossary")) if f":{slot}}}}}" not in template)
        if options.lang_runs:
            body = scripts.wrap(body, options.lang)
        slots = {"content": body, "toc": toc, "title": got["title"], "lang": machine.escape_attr(options.lang), "header": header, "head": got["head"], "pager": "", "citations": listed["cite"], "glossary": listed["gloss"]}
        slots |= {f"var:{k}": v for k, v in variables(options).items()}
        filled = fill(template, slots)
        return {"html": filled if options.document_template else got["start"] + filled + got["tail"], "title": got["title"], "error": None}
    body += listed["cite"] + listed["gloss"]
    if options.lang_runs:
        body = scripts.wrap(body, options.lang)
    return {"html": got["start"] + (header if options.html5 and not options.extract else "") + toc + body + got["tail"], "title": got["title"], "error": None}


def fill(template: str, slots: dict[str, str], namespace: str = "quire") -> str:
    """Each {{namespace:slot}} once; unknown ones stay."""
    import re

    return re.sub(rf"\{{\{{{namespace}:([^}}]*)\}}\}}", lambda m: slots.get(m.group(1), m.group()), template)


def to_html(docs: DataFrame, options: ConvertOptions | None = None, dictionaries: Iterable[str] = (), template: str = "", key: str = "doc_id", text: str = "text", last: Iterable[str] = ()) -> DataFrame:
    """key, html, title, error. A document that fails or is refused has its reason in error and no html; the others go on."""
    options = settled(options or ConvertOptions())
    check(options)
    rules, sides = load_rules(options, dictionaries, last), side_texts(options)
    schema = StructType([docs.schema[key], StructField("html", StringType()), StructField("title", StringType()), StructField("error", StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, got = batch.slice(at, 64), []
                for t in part.column(1).to_pylist():
                    try:
                        got.append(document(t or "", options, rules, template, sides=sides))
                    except Exception as why:  # one document's failure is its own
                        got.append({"html": None, "title": None, "error": f"{type(why).__name__}: {why}"})
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[n] for g in got], pa.string()) for n in ("html", "title", "error"))], names=[f.name for f in schema])

    return docs.select(key, text).mapInArrow(run, schema)


def runs_to_html(docs: DataFrame, options: ConvertOptions | None = None, run: str = "run_id", order: str = "ord", text: str = "text") -> DataFrame:
    """run, html: the texts of each run, in order, as one document; heading styles, anchors and once-links go on between them."""
    options = settled(options or ConvertOptions())
    rules = load_rules(options)
    together = docs.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("texts"))

    schema = StructType([docs.schema[run], StructField("html", StringType())])

    def convert(batches):
        for batch in batches:
            out = []
            for texts in batch.column(1).to_pylist():
                writer, body, start = machine.Writer(options, rules), "", None
                for t in texts:
                    for r in machine.records(t or ""):
                        start = writer.start(r) if start is None else start
                        body += writer.record(r)
                out.append((start or "") + body + writer.finish() + (writer.tail() if start is not None else ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[run, "html"])

    return together.mapInArrow(convert, schema)


def chunked_pages(docs: DataFrame, options: ConvertOptions | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, page_no, name, html: a page for each top section, or for each chunk_chars characters."""
    options = settled(options or ConvertOptions(chunk=True))
    rules = load_rules(options)
    schema = StructType.fromDDL(f"{key} long, page_no int, name string, html string")

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stem = f"doc-{k}"
                if options.chunk_chars:
                    made = [(f"{stem}-chunk-{i:02d}.html", document(c, options, rules)["html"]) for i, c in enumerate(split_chars(t or "", options.chunk_chars), 1)]
                else:
                    got = machine.to_html(t or "", options, rules)
                    made = sections.paged(got["start"], got["body"], got["tail"], stem, options.section, options.toc)
                rows += [(k, i, name, html) for i, (name, html) in enumerate(made, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], names=[key, "page_no", "name", "html"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)


def latest(jobs: DataFrame, key: str, generation: str) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in jobs.columns if c != key]
    return jobs.groupBy(key).agg(F.max_by(F.struct(*rest), generation).alias("r")).select(key, "r.*")


def recent(seen: DataFrame, key: str, at: str, most: int = 10) -> DataFrame:
    """key, last: the keys seen last, newest first; each once, so many at most (a list's length is its feature)."""
    return seen.groupBy(key).agg(F.max(at).alias("last")).orderBy(F.desc("last"), key).limit(most)


def with_previous(jobs: DataFrame, key: str, generation: str, *columns: str) -> DataFrame:
    """jobs with before_NAME for each column: what the key's generation before had."""
    order = Window.partitionBy(key).orderBy(generation)
    return jobs.select("*", *[F.lag(c).over(order).alias(f"before_{c}") for c in columns])
