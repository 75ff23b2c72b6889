"""Notes and glossary: references, definitions, numbers, checks and their lists.

Markers are {{NS:cite:KEY}} and {{NS:gloss:KEY}} for references, {{NS:def:cite:KEY}} ... {{/NS:def:cite:KEY}} for definitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.templates import NAMESPACE

KINDS = {"cite": "notes", "gloss": "glossary"}
KEY = "[A-Za-z0-9._-]+"


def markers(bodies: DataFrame, key: str = "doc_id", html: str = "html", namespace: str = NAMESPACE) -> DataFrame:
    """key, pos, role (ref, def, end), kind, note of each marker in order."""
    whole = rf"\{{\{{/?{namespace}:(?:def:)?(?:cite|gloss):{KEY}\}}\}}"
    rows = bodies.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(whole), F.lit(0))).alias("pos", "m"))
    role = F.when(F.startswith("m", F.lit("{{/")), "end").when(F.contains("m", F.lit(":def:")), "def").otherwise("ref")
    return rows.select(key, "pos", role.alias("role"), F.regexp_extract("m", "(cite|gloss):", 1).alias("kind"), F.regexp_extract("m", rf"(?:cite|gloss):({KEY})", 1).alias("note"))


def numbered(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """References with number, by first mention, and whether they are the first of their note."""
    refs = marked.where("role = 'ref'")
    first = F.min("pos").over(Window.partitionBy(key, "kind", "note"))
    rows = refs.withColumn("__first", first)
    return rows.select(key, "pos", "kind", "note", F.dense_rank().over(Window.partitionBy(key, "kind").orderBy("__first")).cast("int").alias("number"), (F.col("pos") == F.col("__first")).alias("first"))


def problems(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, kind, note, problem: undefined, unreferenced or defined more than once."""
    own = marked.where("role != 'end'").groupBy(key, "kind", "note").agg(F.count_if(F.col("role") == "ref").alias("refs"), F.count_if(F.col("role") == "def").alias("defs"))
    what = F.when(F.col("defs") == 0, "undefined").when(F.col("refs") == 0, "unreferenced").when(F.col("defs") > 1, "defined twice")
    return own.withColumn("problem", what).where("problem is not null").select(key, "kind", "note", "problem")


def collect(body: str, kinds: tuple[str, ...] = ("cite", "gloss"), namespace: str = NAMESPACE) -> tuple[str, dict[str, list[dict]], list[str]]:
    """(body with references as links and without definitions, notes by kind, problems)."""
    notes: dict[str, list[dict]] = {k: [] for k in KINDS}
    wrong: list[str] = []

    def entry(kind: str, note: str) -> dict:
        found = next((n for n in notes[kind] if n["key"] == note), None)
        if found is None:
            notes[kind].append(found := {"key": note, "number": len(notes[kind]) + 1, "content": "", "referenced": False, "defined": False})
        return found

    marker = re.compile(rf"\{{\{{(/?){namespace}:(def:)?(cite|gloss):({KEY})\}}\}}")
    out, at, open_ = [], 0, None
    while m := marker.search(body, at):
        closes, defines, kind, note = m.group(1) == "/", bool(m.group(2)), m.group(3), m.group(4)
        if kind not in kinds:
            if open_ is None:
                out.append(body[at : m.end()])
            at = m.end()
            continue
        if open_ is not None:
            if closes and (kind, note) == open_[:2]:
                content = body[open_[2] : m.start()].strip("\n\r \t")
                own = entry(kind, note)
                if not content:
                    wrong.append(f"definition {note} is empty")
                elif own["defined"]:
                    wrong.append(f"definition {note} is given more than once")
                else:
                    own["defined"], own["content"] = True, content
                end = m.end()
                if "".join(out).rstrip().endswith("<p>") and (tail := re.match(r"\s*</p>", body[end:])):
                    text = "".join(out).rstrip()
                    out, end = [text[:-3]], end + tail.end()
                line = body.find("\n", end)
                at, open_ = (len(body) if line < 0 else line + 1), None
            else:
                at = m.end()
            continue
        if closes:
            wrong.append(f"{m.group()} closes nothing")
            out.append(body[at : m.end()])
            at = m.end()
        elif defines:
            out.append(body[at : m.start()])
            line = body.find("\n", m.end())
            at = len(body) if line < 0 else line + 1
            open_ = (kind, note, at if marker.search(body, m.end()) is None or marker.search(body, m.end()).start() >= at else m.end())
            at = open_[2]
        else:
            own = entry(kind, note)
            first, own["referenced"] = not own["referenced"], True
            name = "note" if kind == "cite" else "gloss"
            id_ = f' id="{name}-ref-{note}"' if first else ""
            out.append(body[at : m.start()] + f'<a class="{name}-ref"{id_} href="#{name}-{note}">{"[" + str(own["number"]) + "]" if kind == "cite" else note}</a>')
            at = m.end()
    if open_ is not None:
        wrong.append(f"definition {open_[1]} is never closed")
    else:
        out.append(body[at:])
    for kind in KINDS:
        for n in notes[kind]:
            if not n["defined"]:
                wrong.append(f"reference to {n['key']} has no definition")
            elif not n["referenced"]:
                wrong.append(f"definition {n['key']} is never referenced")
    return "".join(out), notes, wrong


def render(kind: str, notes: list[dict]) -> str:
    """The list of a kind; empty if there are none."""
    if not notes:
        return ""
    name = KINDS[kind]
    if kind == "cite":
        items = "".join(f'<li class="note" id="note-{n["key"]}"><a class="note-back" href="#note-ref-{n["key"]}">{n["number"]}</a> {n["content"]}</li>\n' for n in notes)
        body = f'<ol class="notes-list">\n{items}</ol>\n'
    else:
        items = "".join(f'<dt id="gloss-{n["key"]}">{n["key"]}</dt>\n<dd class="gloss-def">{n["content"]}</dd>\n' for n in notes)
        body = f'<dl class="glossary-list">\n{items}</dl>\n'
    return f'<section class="{name}" id="{name}">\n<h2 class="{name}-heading">{"Notes" if kind == "cite" else "Glossary"}</h2>\n{body}</section>\n'
