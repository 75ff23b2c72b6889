"""HTML extraction by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path (tag, classes and id of each element down to it), and
its blocks of text at their path. A token's occurrence vector holds how often each page of the host has it. Spark adds
vectors up as order-free hashes, with support and total, so tokens of equal vectors fall into one equivalence class
without any page's tokens being gathered. Classes of enough support are valid if their members nest: a class
hangs below the class of its members' nearest ancestor. The class that occurs once on every page is the skeleton.

The nested classes are the host's template; what lies between its tokens are slots. The main slot is the
skeleton's article or main element, else the deepest element that holds most of the text that no mark (a navigation,
footer, aside, form, advert, comments, ...) sets apart. A host of several layouts shares little skeleton; elements of one
layout have one vector, so each class of enough support that leads to a slot of its own gives the template of a layout.
Extraction takes the blocks in the main slot, leaves out marked parts inside it. Where the slot was found by its text alone,
blocks that are themselves tokens of the template (the same words, once on each page of the skeleton or layout) are left out
too, but for pages that would have nothing left; an article or main element is taken as it stands.

Vectors are sums of page hashes over all pages of a host, so repeated pages weigh on all their tokens alike. What is gathered
for a host is what a fifth of its pages have: a few pages' worth of tokens, however many pages there are. Pages are
read twice.

Defined cases: null, empty and blank html has empty text and is no page of its host's template; a null or odd url is host '';
a host whose pages share no skeleton element falls back on the page's own article, main or body; unclosed and crossed
tags are closed as browsers would in the plain cases; very long pages and blocks are taken whole; texts of blocks are told
apart by a hash of all their words; repeated rows each get a row; ties go to the longer path; an empty table gives an empty
result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quire.llm.common import map_rows, parts
from quire.session import written

# What HTML says of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
# Elements, roles and name words that set a part apart from the article.
APART = frozenset("nav footer aside form script style head noscript template iframe object svg button select textarea title dialog menu canvas audio video noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social comment comments disqus related recommended login search searchbox pagination pager copyright toolbar widget widgets".split())
OUTSIDE = frozenset(("header", "masthead", "topbar"))
NOT_IF_AFTER = frozenset("no not with has without is hide".split())
MAIN = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
HOST = re.compile(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m.group(1).lower() if m else ""


def label(tag: str, attributes: str, inside_main: bool) -> str:
    """An element's step in a path: tag, classes and id without digits; with a ! before it if it is set apart."""
    apart, names = tag in APART or tag in OUTSIDE and not inside_main, ""
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            if m.start() and attributes[m.start() - 1] not in " \t\r\n\f\"'/":
                continue
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id"):
                words = [w.lower() for w in NAME_WORD.findall(value)]
                for before, w in zip(["", *words], words):
                    if (w in NAMES or w in OUTSIDE and not inside_main) and before not in NOT_IF_AFTER:
                        apart = True
                names += ("." if key == "class" else "#") + "-".join(words)
            elif key == "role":
                apart |= value.lower() in ROLES
                names += f"@{value.lower()}" if value.lower() == "main" else ""
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                apart = True
    return ("!" if apart and tag not in ("html", "body", *MAIN) else "") + tag + names.replace("/", "")


def events(page: str) -> Iterator[tuple[str, str | None]]:
    """(path, None) for each element that opens and (path, text) for each block, in page order; white space is collapsed."""
    tags: list[str] = []
    paths: list[str] = [""]
    held: list[str] = []
    held_at = ""

    def flush():
        nonlocal held
        text = " ".join("".join(held).split()) if held else ""
        held = []
        return text

    def close(to: int):
        del tags[to:]
        del paths[to + 1 :]

    def block_path() -> str:
        i = len(tags)
        while i and tags[i - 1] in INLINE and "!" not in paths[i][len(paths[i - 1]) :]:
            i -= 1
        return paths[i]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        raw = page[at : m.start() if m else size]
        if raw:
            path = block_path()
            if path != held_at and held:
                if text := flush():
                    yield held_at, text
            held_at = path
            held.append(entities.unescape(raw) if "&" in raw else raw)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, ends = m.group(2).lower(), m.group(1) == "/"
        if tag not in INLINE:
            if text := flush():
                yield held_at, text
        elif tag == "br":
            held.append(" ")
        if ends:
            if tag in tags:
                close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tag in CLOSES:
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in SCOPES[tag]:
                    break
                if tags[i] in CLOSES[tag]:
                    close(i)
                    break
        elif tag not in INLINE and "p" in tags:
            # a block ends an open paragraph of its own container
            i = len(tags) - 1 - tags[::-1].index("p")
            if all(t in INLINE for t in tags[i + 1 :]):
                close(i)
        step = label(tag, m.group(3), any(t in MAIN for t in tags))
        path = f"{paths[-1]}/{step}"
        if tag not in INLINE or step[0] == "!":
            yield path, None
        if tag in VOID or m.group(3).endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        tags.append(tag)
        paths.append(path)
    if text := flush():
        yield held_at, text


TOKENS = StructType([StructField("host", StringType()), StructField("token", StringType()), StructField("page", LongType()), StructField("times", LongType()), StructField("chars", LongType())])


def text_token(path: str, text: str) -> str:
    """A block's token: its path, a tab, and a hash of the whole text."""
    return f"{path}\t{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def tokens(pages: DataFrame) -> DataFrame:
    """host, token, page, times, chars of text straight in it: each token of each page once. A page that has any has the token ''."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, 64):
                out = []
                for key, url, page in zip(*(part.column(i).to_pylist() for i in range(3))):
                    found: dict[str, list[int]] = {}
                    for path, text in events(page or ""):
                        if text is None:
                            found.setdefault(path, [0, 0])[0] += 1
                        else:
                            found.setdefault(path, [0, 0])[1] += len(text)
                            found.setdefault(text_token(path, text), [0, 0])[0] += 1
                    if found:
                        found[""] = [1, 0]
                    host = host_of(url)
                    out += [(host, token, key, times, chars) for token, (times, chars) in found.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i < 2 else pa.int64()) for i in range(5)], names=[f.name for f in TOKENS])

    rows = pages.select(F.xxhash64(F.col("page_id"), F.col("url"), F.col("html")).alias("key"), "url", "html")
    return rows.mapInArrow(run, TOKENS)


#: A host's template: where the main slot of each of its layouts is, and the texts that are tokens of them.
TEMPLATE = StructType([StructField("host", StringType()), StructField("slots", ArrayType(StringType())), StructField("fixed", ArrayType(StringType()))])
#: Elements that a slot without a name can be.
BOXES = frozenset("div section table tbody tr td center span".split())


def steps(path: str) -> list[str]:
    return path.split("/")[1:]


def nest(classes: dict[tuple, list[str]]) -> dict[tuple, tuple | None]:
    """The class that each class of paths hangs below: that of its first member's nearest ancestor in another class.

    Classes whose members hang below different classes are not valid and left out."""
    of = {path: key for key, members in classes.items() for path in members}
    found = {}
    for key, members in classes.items():
        above = set()
        for path in members:
            up = path.rpartition("/")[0]
            while up and of.get(up, key) == key:
                up = up.rpartition("/")[0]
            above.add(of.get(up))
        if len(above) == 1:
            found[key] = above.pop()
    return found


def main_slots(pages: int, rows: list[tuple[str, int, int, int, int]], share: float = 0.2) -> tuple[list[str], list[str]]:
    """(paths of the main slots, fixed texts) from a host's tokens: (token, support, total, vector, chars)."""
    classes: dict[tuple, list[str]] = {}
    open_text: dict[str, int] = {}  # text below a path that nothing further down sets apart
    for token, support, total, vector, n in rows:
        if "\t" not in token and token:
            classes.setdefault((support, total, vector), []).append(token)
            while n and token:
                open_text[token] = open_text.get(token, 0) + n
                token, _, step = token.rpartition("/")
                if step[0] == "!":
                    break
    inside = lambda path: open_text.get(path, 0)
    valid = nest(classes)
    once = {key for key in valid if key[0] == key[1] and key[0] >= share * pages}
    common = {key for key in once if key[0] >= 0.8 * pages}
    skeleton = {p for key in common for p in classes[key]}

    named = [p for p in skeleton if (last := steps(p)[-1]).lstrip("!").startswith(MAIN) or "@main" in last]
    named = [p for p in named if "/!" not in p] or named
    if named:
        # an article inside main, if it holds most of it
        best = max(named, key=lambda p: (inside(p), len(p), p))
        for p in sorted(named, key=len):
            if p.startswith(best + "/") and 2 * inside(p) > inside(best):
                best = p
        if inside(best):
            return [best], []

    def narrowed(slot: str, layout: tuple | None = None) -> str:
        """The deepest element that holds most of the text; with a layout, of the text that isn't in elements of other layouts."""
        paths = skeleton | set(classes.get(layout, ()))
        others = [p for key in (once - common if layout else ()) for p in classes[key] if p not in paths and steps(p)[-1][0] != "!"]
        while True:
            below = [p for p in paths if p.rpartition("/")[0] == slot and steps(p)[-1][0] != "!" and element(steps(p)[-1]) in BOXES]
            best = max(below, key=lambda p: (inside(p), len(p), p), default=None)
            whole = inside(slot) - sum(inside(p) for p in others if p.rpartition("/")[0] == slot)
            if best is None or not inside(best) or 10 * inside(best) < 7 * whole:
                return slot
            slot = best

    bodies = sorted((p for p in skeleton if steps(p)[-1].startswith("body")), key=len)
    body = bodies[0] if bodies else ""
    slots, layouts = [narrowed(body)] if body else [], set(common)
    if body and slots[0] == body:
        for key in sorted(once - common, key=lambda k: (-k[0], k)):
            slot = narrowed(body, key)
            if slot != body and slot not in slots:
                slots.insert(len(slots) - 1, slot)
                layouts.add(key)
    fixed = [t for t, support, total, vector, _ in rows if "\t" in t and pages >= 5 and support == total and (support >= 0.8 * pages or (support, total, vector) in layouts)]
    return slots, fixed


def templates(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """TEMPLATE of each host. Tokens count from two pages and `share` of the host's pages on."""
    half = F.lit(1 << 31)
    seen = F.xxhash64("page", "times")
    # two sums of 31 bits stay far from overflow, whatever the host's size
    vector = F.xxhash64(F.sum(F.pmod(seen, half)), F.sum(F.pmod(F.shiftright(seen, 32), half)))
    vectors = tokens(pages).groupBy("host", "token").agg(F.count("*").alias("support"), F.sum("times").alias("total"), vector.alias("vector"), F.sum("chars").alias("chars"))
    vectors = written(vectors.where("support > 1 or instr(token, '\t') = 0"), "html-vectors")
    of_host = vectors.where("token = ''").select(F.col("host").alias("its"), F.col("support").alias("pages"))
    kept = vectors.join(of_host, F.col("host") == F.col("its")).where((F.col("support") >= share * F.col("pages")) & ((F.col("support") > 1) | (F.col("pages") == 1)))
    by_host = kept.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(F.struct("token", "support", "total", "vector", "chars")).alias("rows"))

    def deduce(hosts, pages_, rows):
        found = [main_slots(n, [tuple(r[k] for k in ("token", "support", "total", "vector", "chars")) for r in own], share) for n, own in zip(pages_, rows)]
        return {"host": hosts, "slots": [f[0] for f in found], "fixed": [f[1] for f in found]}

    return written(map_rows(by_host, ["host", "pages", "rows"], deduce, TEMPLATE), "html-templates")


def element(step: str) -> str:
    """The tag of a path's step."""
    return re.match(r"!?([^.#@]*)", step).group(1)


def own_slot(paths: list[str], tags: tuple[str, ...]) -> str:
    """The path of the first element of the first of these tags that any of the paths goes through, marked ones last."""
    for wanted in tags:
        found = [path for path in paths if any(element(s) == wanted for s in steps(path))]
        for path in sorted(found, key=lambda p: "/!" in p)[:1]:
            at = next(i for i, s in enumerate(steps(path)) if element(s) == wanted)
            return "/" + "/".join(steps(path)[: at + 1])
    return ""


def main_text(page: str | None, slots: list[str], fixed: frozenset[str]) -> str:
    """The blocks of the main slot, in page order.

    A page takes the first slot that it has. One that is no article or main gives way to the page's own one; a page without a
    slot has its own article, main or body."""
    blocks = [(path, text) for path, text in events(page or "") if text is not None]
    paths = [path for path, _ in blocks]
    below = lambda path, slot: path == slot or path.startswith(slot + "/")
    slot = next((s for s in slots if any(below(p, s) for p in paths)), "")
    if not slot:
        slot = own_slot(paths, (*MAIN, "body"))
    elif element(steps(slot)[-1]) not in MAIN and "@main" not in slot:
        slot = own_slot([p for p in paths if below(p, slot)], MAIN) or slot
    inner = [(path, text) for path, text in blocks if (not slot or below(path, slot)) and "/!" not in path[len(slot) :]]
    own = [text for path, text in inner if not fixed or text_token(path, text) not in fixed]
    return "\n\n".join(own or [text for _, text in inner])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    found = templates(pages).withColumnRenamed("host", "its")
    own = pages.select("page_id", "url").schema
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(found, F.col("host") == F.col("its"), "left")
    schema = StructType([*own, StructField("text", StringType()), StructField("n_chars", LongType())])
    sets: dict = {}

    def run(ids, urls, htmls, hosts, slots, fixed):
        texts = []
        for page, host_, places, words in zip(htmls, hosts, slots, fixed):
            if host_ not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[host_] = frozenset(words or ())
            texts.append(main_text(page, places or [], sets[host_]))
        return {own[0].name: ids, own[1].name: urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(rows, ["page_id", "url", "html", "host", "slots", "fixed"], run, schema)


def query(pages: DataFrame) -> DataFrame:
    return extract(pages)
