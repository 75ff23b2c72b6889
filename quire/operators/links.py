"""Link rules: a dictionary of patterns, their literals as a prefilter, and their use on a finished paragraph."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.urls import REFUSED

# The services, newsgroup hierarchies and rules of the built-in dictionary, in order.
SERVICES = (
    ("snews", r"[\w.]+"), ("news", r"[\w.]+"), ("nntp", r"[\w/.:+\-]+"), ("http", r"[\w/.:@+\-~%#?=&;,]+[\w/]"), ("shttp", r"[\w/.:+\-~%#?=&;,]+"), ("https", r"[\w/.:+\-~%#?=&;,]+"),
    ("file", r"[\w/.:+\-]+"), ("ftp", r"[\w/.:+\-]+"), ("wais", r"[\w/.:+\-]+"), ("gopher", r"[\w/.:+\-]+"), ("telnet", r"[\w/@.:+\-]+"),
)
NEWSGROUPS = "alt bionet bit biz clari comp gnu humanities k12 misc news rec soc talk us ch de".split()
SITE = r"[A-Za-z][\w.+\-]+\.[A-Za-z]{2,}"
DICTIONARY = (
    [
        (r"&lt;URL:([-\w./:~_@]+):([a-zA-Z0-9'() ]+)&gt;", "h", '<A HREF="$1">$2</A>'),
        (r'&lt;URL:\s*([^\s"]+?)\s*&gt;', "h", '<A HREF="$1">$1</A>'),
        (r'&lt;(http:[^\s"]+?)\s*&gt;', "h", '&lt;<A HREF="$1">$1</A>&gt;'),
    ]
    + [(rf"{name}:{rest}", "", "$&") for name, rest in SERVICES]
    + [(rf"([^\w\-/.:@>])({group}\.[\w.+\-]+[\w+\-]+)", "h", '$1<A HREF="news:$2">$2</A>') for group in NEWSGROUPS]
    + [(rf"({user}@)({SITE}):(\s*)([\w\d+\-/.]+)", "h", '$1<A HREF="ftp://$2/$4">$2:$4</A>$3') for user in ("anonymous", "ftp")]
    + [
        (r"[A-Za-z0-9_+\-.]+@([A-Za-z0-9][\w.+\-]+\.[A-Za-z]{2,})", "", "mailto:$&"),
        (rf"([^\w\-/.:@>])({SITE}):(\s*)([\w\d+\-/.]+)", "h", '$1<A HREF="ftp://$2/$4">$2:$4</A>$3'),
        (r"([^\w\-/.:@])(\d{2,}\.\d{2,}\.\d+\.\d+):([\w\d+\-/.]+)", "h", '$1<A HREF="ftp://$2/$3">$2:$3</A>'),
        (r"telnet ([A-Za-z][\w+\-]+(\.[\w.+\-]+)+\.[A-Za-z]{2,})\s+(\d{2,4})", "h", 'telnet <A HREF="telnet://$1:$3/">$1 $3</A>'),
        (r"ftp ([A-Za-z][\w+\-]+(\.[\w.+\-]+)+\.[A-Za-z]{2,})", "h", 'ftp <A HREF="ftp://$1/">$1</A>'),
        (r"\b([A-Za-z][\w])*ftp[\w]*(\.[\w+\-]+){2,}", "h", 'ftp <A HREF="ftp://$&/">$&</A>'),
        (r'ftp(\.[\w@:-]+)+/[^\s"]+', "", "ftp://$&"),
        (r'www(\.[\w@:-]+)+/[^\s"]+', "", "http://$&"),
        (r"\b([A-Za-z][\w])*www[\w]*(\.[\w+\-]+){2,}", "", "http://$&/"),
        (r"([A-Za-z][\w+\-]+\.[\w+\-]+\.[A-Za-z]{2,})\s+(\d{2,4})", "h", '<A HREF="telnet://$1:$2/">$1 $2</A>'),
        (r"([^\w\-/.:@])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\s+(\d{1,4})", "h", '$1<A HREF="telnet://$2:$3">$2 $3</A>'),
        (r"([^\w\-/.:@])(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", "h", '$1<A HREF="telnet://$2">$2</A>'),
        (r"RFC ?(\d+)", "i", "http://www.cis.ohio-state.edu/rfc/rfc$1.txt"),
    ]
)

ENTRY = re.compile(r"\s*(.+)\s+-+(?:([iehos]+)-+)?>\s*(.*\S+)\s*\n", re.I)
TAG_CASE = re.compile(r"</?[A-Z][A-Z0-9]*\b|\b[A-Z]+(?==\")")


def ascii_pattern(pattern: str, no_case: bool = False) -> re.Pattern:
    """A pattern with ASCII classes, a dot for any character, and $ for the end or before one last line feed."""
    pattern = pattern.replace("[[:alpha:]]", "[A-Za-z]").replace("[[:alnum:]]", "[A-Za-z0-9]").replace("[:alpha:]", "A-Za-z").replace("[:alnum:]", "A-Za-z0-9").replace(r"\<", r"\b").replace(r"\>", r"\b")
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\$(?=\)|\||$)", r"\1(?=\\n?\\Z)", pattern)
    return re.compile(pattern, re.ASCII | re.DOTALL | (re.I if no_case else 0))


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    pattern: str
    switches: str
    replacement: str
    literals: tuple[str, ...] | None

    @property
    def regex(self) -> re.Pattern:
        return _compiled(self.pattern, "i" in self.switches)


@lru_cache(512)
def _compiled(pattern: str, no_case: bool) -> re.Pattern:
    return ascii_pattern(pattern, no_case)


def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Lower-case strings one of which every match has; None if none could be proven. Read off the parsed pattern."""
    from re import _constants as c
    from re import _parser

    def best(items) -> tuple[str, ...] | None:
        found, run = [], ""
        for op, value in items:
            if op is c.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if run:
                found.append((run,))
                run = ""
            if op is c.SUBPATTERN:
                inner = best(value[3])
                found += [inner] if inner else []
            elif op is c.MAX_REPEAT and value[0] >= 1:
                inner = best(value[2])
                found += [inner] if inner else []
            elif op is c.BRANCH:
                each = [best(b) for b in value[1]]
                if all(each):
                    found.append(tuple(x for e in each for x in e))
        if run:
            found.append((run,))
        return max(found, key=lambda alternatives: min(map(len, alternatives)), default=None)

    try:
        return best(_parser.parse(ascii_pattern(pattern).pattern, re.ASCII | re.DOTALL))
    except re.error:
        return None


def glob_pattern(glob: str) -> str:
    return r"\b" + "".join("." if ch == "?" else ".*" if ch == "*" else ch for ch in glob) + r"\b"


def literal_pattern(text: str) -> str:
    return r"\b" + re.sub(r"([^A-Za-z0-9_])", r"\\\1", text) + r"\b"


def dictionary_lines(text: str) -> str:
    """The dictionary without comments and lines that end in an unescaped colon."""
    return "".join(f"{line}\n" for line in text.split("\n") if not line.startswith("#") and not re.search(r"[^\\\r]:\s*$", line))


def parse_dictionary(text: str) -> list[tuple[str, str, str, str]]:
    """(label, pattern, switches, target) of each KEY -[switches]-> TARGET entry: /re/, |re|, "words" or a glob."""
    found = []
    for m in ENTRY.finditer(dictionary_lines(text) + "\n"):
        key, switches, target = m.group(1).rstrip(), (m.group(2) or "").lower(), m.group(3)
        if key[0] in "/|":
            body = key[1:].removesuffix(key[0])
            found.append((body, body, switches, target))
        elif '"' in key:
            body = key.removeprefix('"').removesuffix('"')
            found.append((body, literal_pattern(body), switches, target))
        else:
            found.append((key, glob_pattern(key), switches, target))
    return found


def lower_tags(html: str) -> str:
    return TAG_CASE.sub(lambda m: m.group().lower(), html)


def scheme(url: str) -> str | None:
    """As urls.scheme_of, for one string."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", re.sub(r"\A[\x00-\x20\x7f]+", "", url).translate({9: None, 10: None, 13: None}))
    return m.group(1).lower() if m else None


def allows(url: str, policy: tuple[str, ...] = ()) -> bool:
    found = scheme(url)
    return found is None or (found in policy if policy else found not in REFUSED)


def load_rules(dictionaries: Iterable[str] = (), policy: tuple[str, ...] = (), lower_case: bool = True, built_in: bool = True, last: Iterable[str] = ()) -> tuple[list[Rule], list[str]]:
    """(rules, problems): entries of the dictionaries, then the built-in ones, then those of the last dictionaries; the first of a label counts.

    Patterns that don't compile, or that match nothing at all over and over, and targets of refused schemes are problems."""
    own = [(p, p, s, t) for p, s, t in DICTIONARY] if built_in else []
    entries = [*(e for text in dictionaries for e in parse_dictionary(text)), *own, *(e for text in last for e in parse_dictionary(text))]
    rules, problems, seen = [], [], set()
    for label, pattern, switches, target in entries:
        if label in seen:
            continue
        seen.add(label)
        try:
            compiled = _compiled(pattern, "i" in switches)
        except re.error as why:
            problems.append(f"{label}: {why}")
            continue
        if not set("os") & set(switches) and compiled.match(""):
            problems.append(f"{label}: matches the empty string")
            continue
        if "h" not in switches and "$" not in target and not allows(target, policy):
            problems.append(f"{label}: scheme {scheme(target)} is refused")
            continue
        replacement = target if "h" in switches else f'<A HREF="{target}">$&</A>'
        rules.append(Rule(len(rules), label, pattern, switches, lower_tags(replacement) if lower_case else replacement, required_literals(pattern)))
    return rules, problems


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """ord, label, pattern, switches, replacement, literals; a dictionary, so as small as its file."""
    return spark.createDataFrame([(r.order, r.label, r.pattern, r.switches, r.replacement, list(r.literals) if r.literals else None) for r in rules], "ord int, label string, pattern string, switches string, replacement string, literals array<string>")


def may_match(text: Column, literals: Column) -> Column:
    """Whether a text, in lower case, may match a rule of these literals; false is certain. Used before the pattern itself."""
    return literals.isNull() | F.exists(literals, lambda x: F.contains(text, x))


def expand(template: str, match: re.Match) -> str:
    return re.sub(r"\\\$|\$(&|\d)", lambda m: "$" if m.group(1) is None else match.group() if m.group(1) == "&" else (match.group(int(m.group(1))) or "") if int(m.group(1)) <= match.re.groups else "", template)


def inside_markup(matched: str, before: str, lower_case: bool = True, end: int | None = None) -> bool:
    """Whether a match stands in a link or in a tag, by the text before it, up to end."""
    folded = matched.lower()
    if "</a>" in folded or "<a>" in folded:
        return True
    opened, closed = ("<a ", "</a>") if lower_case else ("<A ", "</A>")
    last = lambda sign: before.rfind(sign, 0, end)
    return last(opened) > last(closed) or last("<") > last(">")


class Emitted:
    """Text that only grows at its end, and whether that end stands in a link or in a tag; each piece is looked through once."""

    def __init__(self, lower_case: bool = True):
        self.signs = ("<a ", "</a>", "<", ">") if lower_case else ("<A ", "</A>", "<", ">")
        self.pieces: list[str] = []
        self.at, self.tail, self.last = 0, "", dict.fromkeys(self.signs, -1)

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        seen = self.tail + piece  # a sign may begin in the piece before
        for sign in self.signs:
            if (found := seen.rfind(sign)) >= 0:
                self.last[sign] = self.at - len(self.tail) + found
        self.at += len(piece)
        self.tail = seen[-3:]

    def inside(self, matched: str) -> bool:
        """As inside_markup, for what comes next."""
        opened, closed, left, right = (self.last[sign] for sign in self.signs)
        folded = matched.lower()
        return "</a>" in folded or "<a>" in folded or opened > closed or left > right


def clue_of(rules: list[Rule]) -> re.Pattern | None:
    """Finds a literal of any rule; None if some rule has none. What it doesn't find in a lower-case text no rule matches."""
    if not all(r.literals for r in rules):
        return None
    return re.compile("|".join(sorted({re.escape(x) for r in rules for x in r.literals})) or r"(?!)")


def apply_rules(text: str, rules: list[Rule], used: set[int], used_here: set[int], lower_case: bool = True) -> str:
    """All rules in order over a paragraph, each from left to right, never inside earlier links.

    used: rules of switch o that had their match in this run; used_here: those of switch s in this record."""
    folded = text.lower()
    for rule in rules:
        if rule.literals and not any(x in folded for x in rule.literals):
            continue
        spent = used if "o" in rule.switches else used_here if "s" in rule.switches else None
        if spent is not None and rule.order in spent:
            continue
        done, rest = Emitted(lower_case), text
        while (m := rule.regex.search(rest)) and m.end():
            done.put(rest[: m.start()])
            done.put(m.group() if done.inside(m.group()) else expand(rule.replacement, m))
            rest = rest[m.end() :]
            if spent is not None:
                spent.add(rule.order)
                break
        if done.pieces:
            text = "".join(done.pieces) + rest
            folded = text.lower()
    return text


OPEN_ANCHOR = re.compile(r"<a(?=[\s>])[^>]*>", re.I)
HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def scrub(html: str, policy: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """(html without anchors whose scheme is refused, their text kept; the schemes in the order met)."""
    folded, cuts, dropped = html.lower(), {}, []
    for m in OPEN_ANCHOR.finditer(html):
        href = HREF.search(m.group())
        url = next((g for g in href.groups() if g is not None), "") if href else ""
        if href is None or allows(url, policy):
            continue
        if (name := scheme(url)) not in dropped:
            dropped.append(name)
        cuts[m.start()] = m.end()
        end = folded.find("</a>", m.end())
        while end in cuts:
            end = folded.find("</a>", end + 4)
        if end >= 0:
            cuts[end] = end + 4
    out, at = [], 0
    for start, end in sorted(cuts.items()):
        out.append(html[at:start])
        at = end
    return "".join([*out, html[at:]]), dropped


def with_rel(html: str) -> str:
    """rel="nofollow noreferrer" on each anchor that leads outside and has none."""
    def one(m: re.Match) -> str:
        href = HREF.search(m.group())
        url = next((g for g in href.groups() if g is not None), "") if href else ""
        if scheme(url) not in ("http", "https", "ftp", "ftps") or re.search(r"\srel\s*=", m.group(), re.I):
            return m.group()
        return f'{m.group()[:2]} rel="nofollow noreferrer"{m.group()[2:]}'

    return OPEN_ANCHOR.sub(one, html)


def matches(frame: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, match: all matches of one rule in all texts, natively."""
    return frame.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "match"))


def candidate_pairs(texts: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Each text with the rules it may match. The rules, a dictionary of bounded size, travel inside the rows, so no join multiplies rows."""
    packed = rules.agg(F.collect_list(F.struct("ord", "label", "literals")).alias("r")).first()["r"]
    own = F.array(*[F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["label"]).alias("label"), (F.array(*map(F.lit, r["literals"])) if r["literals"] else F.lit(None).cast("array<string>")).alias("literals")) for r in packed])
    folded = next(f"folded{'_' * i}" for i in range(99) if f"folded{'_' * i}" not in texts.columns)
    kept = F.filter(own, lambda r: may_match(F.col(folded), r["literals"]))
    # lower case once a text, not once a rule; the projection must not be put back into the filter
    lowered = texts.withColumn(folded, F.lower(text)).where(F.col(folded).isNotNull())
    return lowered.select(*texts.columns, F.explode(F.transform(kept, lambda r: F.struct(r["ord"].alias("ord"), r["label"].alias("label")))).alias("rule")).select("*", "rule.ord", "rule.label").drop("rule")


def scrubbed(frame: DataFrame, policy: tuple[str, ...] = (), key: str = "doc_id", html: str = "html") -> DataFrame:
    """key, html without refused anchors, dropped: their schemes in the order met, comma-joined."""
    schema = StructType([frame.schema[key], StructField("html", StringType()), StructField("dropped", StringType())])

    def run(batches):
        for batch in batches:
            done = [scrub(t or "", policy) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([",".join(d[1]) for d in done], pa.string())], names=[f.name for f in schema])

    return frame.select(key, html).mapInArrow(run, schema)
