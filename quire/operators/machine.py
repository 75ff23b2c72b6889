"""Structure of one document: paragraphs, headings, lists, tables, preformatted text, mail and inline marks as HTML.

A document is read in order, since what a line means depends on what is open before it. `Writer` holds what is open
(tags, lists, preformatted text) and what has been counted (heading styles, anchors); a paragraph is a list of `Line`,
and each line may still change the one before it. No Spark here: see convert.py."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

from quire.functions.chars import CODES, ENTITIES, SMART
from quire.functions.predicates import class_body
from quire.operators import links, tables
from quire.operators.records import LINE, expand_tabs
from quire.options import ConvertOptions, settled

END_OF_LINE = r"(?=\n?\Z)"
SPACE = " \t\n\r\f\x0b"
OPTIONAL_END = ("p", "li", "dt", "dd")
ENTITY_TABLE = {ord(c): e for c, e in ENTITIES.items()}
SMART_TABLE = {ord(c): e for c, e in SMART}
CODE_TABLE = {ord(c): e for c, e in CODES}
ESCAPES = {ord("&"): "&amp;", ord("<"): "&lt;", ord(">"): "&gt;"}
HYPHENATED = re.compile(r"(\s*)([A-Za-z]*)-\n(\s*)([A-Za-z]+['\").,:;}>]*\s*)", re.A)


@lru_cache(256)
def pattern(text: str, no_case: bool = False) -> re.Pattern:
    return links.ascii_pattern(text, no_case)


def escape(text: str) -> str:
    return text.translate(ESCAPES) if "&" in text or "<" in text or ">" in text else text


def escape_attr(text: str) -> str:
    return escape(text).replace('"', "&quot;")


def blank(text: str) -> bool:
    return not text.strip()


@dataclass
class Line:
    text: str
    length: int = 0
    indent: int = 0
    does: set[str] = field(default_factory=set)


@dataclass
class ItemMark:
    """How a line starts a list item: prefix is what its siblings share."""

    prefix: str
    number: str
    term: str


@dataclass
class OpenList:
    kind: str
    prefix: str
    width: int


class Tags:
    """The open elements, and end tags that others imply."""

    def __init__(self, opts: ConvertOptions):
        self.open: list[str] = []
        self.case: Callable[[str], str] = str.lower if opts.lower_case_tags else str.upper
        self.slash = "/" if opts.xhtml else ""
        self.closes = opts.xhtml or (opts.html5 and opts.close_optional_tags)

    def implied(self, name: str, ends: bool) -> str:
        """The end tag that comes before this tag, if the innermost element can't hold it."""
        if not self.closes or not self.open:
            return ""
        inner, starts = self.open[-1], not ends
        if inner == "p":
            due = name == "p" and starts or name.startswith("h") or name in ("ul", "ol", "dl", "pre", "table")
        elif inner == "li":
            due = name == "li" and starts or name in ("ul", "ol") and ends
        elif inner == "dt":
            due = name == "dd" and starts
        else:
            due = inner == "dd" and (name == "dt" and starts or name == "dl" and ends)
        return self.close(inner) if due else ""

    def start(self, name: str, attributes: str = "") -> str:
        before = self.implied(name, False)
        self.open.append(name)
        return f"{before}<{self.case(name)}{attributes}>"

    def empty(self, name: str, attributes: str = "") -> str:
        return f"{self.implied(name, False)}<{self.case(name)}{attributes}{self.slash}>"

    def end(self, name: str) -> str:
        return self.implied(name, True) + self.close(name)

    def close(self, name: str = "") -> str:
        """An end tag; only an element that is the innermost one leaves the stack."""
        name = name or (self.open[-1] if self.open else "")
        if self.open and self.open[-1] == name:
            self.open.pop()
        return f"</{self.case(name)}>"

    def around(self, name: str, text: str) -> str:
        """A line's text in an element, without its line end and leading white space."""
        text = text.removesuffix("\n").removesuffix("\r").lstrip(SPACE).removesuffix("\n")
        return f"{self.start(name)}{text}{self.close(name)}\n"


class Writer:
    """Turns paragraphs of one run of documents into HTML, in order."""

    def __init__(self, options: ConvertOptions | None = None, rules: list[links.Rule] | None = None):
        self.opts = o = settled(options or ConvertOptions())
        self.tags = Tags(o)
        self.lists: list[OpenList] = []
        self.pre = self.pre_marked = False
        self.special = ""  # table or mail: what this paragraph is
        self.styles = {s: i for i, s in enumerate("*=+-~.", 1)} if o.use_mosaic_header else {}
        self.counters: list[int] = []
        self.mails = 0
        self.before: set[str] = set()  # what the last paragraph's last line did
        self.policy = tuple(sorted({s.strip().lower() for s in (o.allowed_url_schemes or "").split(",") if s.strip()}))
        self.rules = rules if rules is not None else links.load_rules(policy=self.policy, lower_case=o.lower_case_tags)[0] if o.make_links else []
        self.clue = links.clue_of(self.rules)
        self.used, self.used_here = set(), set()
        self.dropped: list[str] = []
        self.bullet = f"[{class_body(o.bullets)}]"
        self.number = rf"(\d+|[A-Za-z]|[{class_body(o.bullets_ordered)}])" if o.bullets_ordered else r"(\d+|[A-Za-z_])"
        self.title = ""
        self.head = ""

    def state(self) -> tuple:
        """What is open and counted, in plain values; the options and rules are not part of it."""
        return (self.tags.open, [(x.kind, x.prefix, x.width) for x in self.lists], self.pre, self.pre_marked, self.styles, self.counters, self.mails, self.before, self.used, self.dropped, self.title, self.head)

    def restore(self, state: tuple) -> Writer:
        self.tags.open, opened, self.pre, self.pre_marked, self.styles, self.counters, self.mails, self.before, self.used, self.dropped, self.title, self.head = state
        self.lists = [OpenList(*x) for x in opened]
        return self

    # -- items ------------------------------------------------------------------------------------------------

    def mark_of(self, text: str) -> ItemMark | None:
        """The mark of a list item at the start of a line."""
        term = pattern(rf"\A\s*(\w\w+):{END_OF_LINE}").match(text)
        bulleted = pattern(rf"\A\s*{self.bullet}\s+\S").match(text)
        if not (term or bulleted or pattern(rf"\A\s*{self.number}[.)\]:]\s+\S").match(text)):
            return None
        if term:
            return ItemMark(text[: term.start(1)] + ":", self._number(text), term.group(1))
        number = self._number(text)
        if number:
            raw = pattern(rf"\A\s*{self.number}.").match(text)
            return ItemMark(raw.group().replace(number, "") if raw else "", number, "")
        raw = pattern(rf"\A\s*{self.bullet}.").match(text)
        return ItemMark(raw.group() if raw else "", "", "")

    def _number(self, text: str) -> str:
        found = pattern(rf"\A\s*{self.number}\S\s+\S").match(text)
        number = found.group(1) if found else ""
        if self.opts.bullets_ordered and any(c in self.opts.bullets_ordered for c in number):
            number = "1"
        return "" if "o" in self.opts.bullets and pattern(r"\A\s*o\s").match(text) else number

    def width(self, text: str, term: bool) -> int:
        """Characters that the mark of an item takes up."""
        if term:
            return len(text) - len(text.lstrip(SPACE)) + self.opts.indent_width
        return pattern(rf"\A\s*[\w{class_body(self.opts.bullets + self.opts.bullets_ordered)}]*.?\s*").match(text).end()

    def nesting(self, depth: int) -> str:
        return " " * (depth * self.opts.indent_width)

    def close_lists(self, n: int) -> str:
        out = []
        for _ in range(n):
            out.append(f"{self.nesting(len(self.lists) - 1)}{self.tags.end(self.lists[-1].kind)}\n")
            self.lists.pop()
        return "".join(out)

    def open_list(self, mark: ItemMark, width: int, line: Line, before: Line) -> bool:
        """A new list below the open ones; letters only start one at a."""
        attributes, kind = "", "ul"
        if mark.number:
            if not mark.number.isdigit() and mark.number not in "aA":
                return False
            kind, attributes = "ol", f' start="{mark.number}"' if mark.number.isdigit() and mark.number != "1" else ""
        elif mark.term:
            kind = "dl"
        before.text += f"{self.nesting(len(self.lists))}{self.tags.start(kind, attributes)}\n"
        self.lists.append(OpenList(kind, mark.prefix, width))
        line.does |= {"LIST", "LIST_START"}
        return True

    def next_item(self, mark: ItemMark, line: Line) -> None:
        """The line's mark as an item of the innermost list."""
        kind, space = self.lists[-1].kind, self.nesting(len(self.lists))
        if kind == "ul" and (m := pattern(rf"\A\s*{self.bullet} \s*").match(line.text)):
            line.text = f"{space}{self.tags.start('li')}{line.text[m.end():]}"
            line.does.add("LIST_ITEM")
        elif kind == "ol":
            item = space + self.tags.start("li")
            m = pattern(rf"\A\s*{self.number}.\s*").match(line.text)
            line.text = item + line.text[m.end() :] if m else line.text
            line.does.add("LIST_ITEM")
        elif kind == "dl" and mark.term:
            opening, closing = self.tags.start("dt"), self.tags.end("dt")
            m = pattern(rf"\A\s*\w\w+.{END_OF_LINE}").match(line.text)
            line.text = f"{space}{opening}{mark.term.replace('_', ' ')}{closing}{line.text[m.end():]}" if m else line.text
            line.text += self.tags.start("dd")
            line.does.add("LIST_ITEM")
        line.does.add("LIST")

    def item(self, first: bool, line: Line, before: Line) -> None:
        """Whether a line opens, goes on with or ends lists."""
        mark = self.mark_of(line.text)
        if mark is None or not mark.prefix:
            if not first and not blank(before.text) or not self.lists:
                return
            if first and line.indent == self.lists[-1].width:
                before.text += self.tags.start("p")
                line.does.add("PAR")
            else:
                before.text += self.close_lists(len(self.lists))
                line.does.add("END")
            return
        same = {mark.prefix} | ({" " * (len(mark.number) - 1) + mark.prefix} if len(mark.number) > 1 else set())
        depth = next((i + 1 for i in range(len(self.lists) - 1, -1, -1) if self.lists[i].prefix in same), 0)
        width, nested = self.width(line.text, bool(mark.term)), True
        if 0 < depth != len(self.lists):
            before.text += self.close_lists(len(self.lists) - depth)
            line.does.add("END")
            nested = False
        elif depth != len(self.lists) or not self.lists:
            shift = lambda s: len(s) - len(s.lstrip(" "))
            if self.lists and shift(line.text) <= shift(self.lists[-1].prefix):
                before.text += self.close_lists(len(self.lists))
                line.does.add("END")
            if not (line.indent or first or blank(before.text) or before.does & {"BREAK", "HEADER", "CAPS"}):
                return
            nested = self.open_list(mark, width, line, before)
        if self.lists:
            self.next_item(mark, line)
        if nested:
            line.indent = width

    # -- preformatted -----------------------------------------------------------------------------------------

    def looks_preformatted(self, text: str) -> bool:
        n = self.opts.preformat_whitespace_min
        return bool(pattern(rf"\s{{{n}}}\s*\S|\.{{{n}}}\S").search(text))

    def end_preformatted(self, at: int, lines: list[Line]) -> None:
        line, before = lines[at], lines[at - 1]
        if self.pre_marked:
            if pattern(self.opts.preformat_end_marker, True).search(line.text):
                tag = self.tags.close("pre") + "\n"
                if at == 1:
                    line.text = tag
                else:
                    before.text += tag
                    line.text = ""
                self.pre = self.pre_marked = False
                line.does.add("END")
            return
        ahead = at + 1 < len(lines) and self.looks_preformatted(lines[at + 1].text)
        if not self.looks_preformatted(line.text) and (self.opts.endpreformat_trigger_lines == 1 or not ahead):
            before.text = ("" if at == 1 else before.text) + self.tags.close("pre") + "\n"
            self.pre = False
            line.does.add("END")

    def start_preformatted(self, at: int, lines: list[Line]) -> None:
        line, before, o = lines[at], lines[at - 1], self.opts

        def without_paragraph() -> None:
            if before.text.endswith("<p>"):
                before.text = before.text[:-3]
                self.tags.open.pop()

        if o.use_preformat_marker and pattern(o.preformat_start_marker, True).search(line.text):
            without_paragraph()
            line.text = self.tags.start("pre", " class='quote_explicit'") + "\n"
            self.pre = self.pre_marked = True
            line.does.add("PRE")
        elif "MAILQUOTE" not in before.does | line.does:
            need = o.preformat_trigger_lines
            ahead = at + 1 < len(lines) and self.looks_preformatted(lines[at + 1].text)
            if need == 0 or self.looks_preformatted(line.text) and (need == 1 or ahead):
                without_paragraph()
                line.text = f"{self.tags.start('pre')}\n{line.text}"
                self.pre = True
                line.does.add("PRE")

    # -- lines ------------------------------------------------------------------------------------------------

    def rule(self, line: Line) -> None:
        if pattern(rf"\A\s*+(?:[-_~=*]\s*+){{{self.opts.hrule_min},}}+{END_OF_LINE}").match(line.text):
            line.text = self.tags.empty("hr") + "\n"
            line.does.add("HRULE")
        elif "\f" in line.text:
            line.text = line.text.replace("\f", f"\n{self.tags.empty('hr')}\n")
            line.does.add("HRULE")

    def quote(self, at: int, lines: list[Line]) -> None:
        line, before = lines[at], lines[at - 1]
        if at + 1 >= len(lines) or blank(lines[at + 1].text) or not pattern(r"\A(?:\w*&gt|[|:])").match(line.text):
            return
        end = "\n" if line.text.endswith("\n") else ""
        line.text = line.text.removesuffix("\n") + self.tags.empty("br") + end
        line.does |= {"BREAK", "MAILQUOTE"}
        if not before.does & {"BREAK", "MAILQUOTE"}:
            before.text += self.tags.start("p", " class='quote_mail'")
            line.does.add("PAR")

    def start_paragraph(self, at: int, lines: list[Line], fragment: bool) -> None:
        line, before, o = lines[at], lines[at - 1], self.opts
        last = lines[at - 1].indent if at > 1 else 0
        deeper = line.indent > last + o.par_indent
        ended, plain = "END" in line.does, not line.does - {"END", "MAILQUOTE", "CAPS", "BREAK"}

        def indented(tag: str) -> None:
            before.text += tag + "&nbsp;" * line.indent
            line.text = re.sub(rf"\A {{0,{line.indent}}}", "", line.text)

        if not blank(line.text) and plain and (blank(before.text) or ended or deeper) and not (fragment and at == 1):
            if o.indent_par_break and not blank(before.text) and not ended and deeper:
                indented(self.tags.empty("br"))
                before.does.add("BREAK")
                line.does.add("IND_BREAK")
            elif o.preserve_indent:
                indented(self.tags.start("p"))
                line.does.add("PAR")
            else:
                before.text += self.tags.start("p")
                line.does.add("PAR")
        elif (
            o.indent_par_break and not (self.pre or self.lists or self.special == "table") and not blank(before.text) and not ended
            and before.does & {"IND_BREAK", "PAR"} and not line.does - {"END", "MAILQUOTE", "CAPS"} and line.indent > o.par_indent and line.indent == last
        ):
            indented(self.tags.empty("br"))
            before.does.add("BREAK")
            line.does.add("IND_BREAK")

    def short_line(self, at: int, lines: list[Line]) -> None:
        """A break at the end of a short line that another follows."""
        line, before = lines[at], lines[at - 1]
        tag = self.tags.empty("br")
        length = before.length if at > 1 else 0
        if blank(line.text) or blank(before.text) or length >= self.opts.short_line_length:
            return
        if not line.does & {"END", "HEADER", "HRULE", "LIST", "IND_BREAK", "PAR"} and not before.does & {"HEADER", "HRULE", "BREAK", "IND_BREAK"}:
            before.text = before.text[:-1] + tag + before.text[-1:]
            before.does.add("BREAK")

    def is_caps(self, text: str) -> bool:
        return not re.search("[a-z<]", text) and bool(re.search(f"[A-Z]{{{self.opts.min_caps_length}}}", text))

    def line(self, at: int, lines: list[Line], fragment: bool) -> None:
        """One line; what comes first here decides what may come later."""
        line, o = lines[at], self.opts
        if o.escape_HTML_chars:
            line.text = escape(line.text)
        if o.mailmode and not self.pre_marked:
            self.quote(at, lines)
        if self.pre and o.preformat_trigger_lines:
            self.end_preformatted(at, lines)
        if not self.pre:
            self.rule(line)
            if not blank(line.text):
                self.item(at == 1, line, lines[at - 1])
        if not line.does & {"HEADER", "LIST"} and not self.lists and not self.pre and (o.endpreformat_trigger_lines or o.use_preformat_marker):
            self.start_preformatted(at, lines)
        if not self.pre:
            self.start_paragraph(at, lines, fragment)
            if not self.lists:
                self.short_line(at, lines)
            if o.caps_tag and self.is_caps(line.text):
                line.text = self.tags.around(o.caps_tag, line.text)
                line.does.add("CAPS")

    # -- headings and mail ------------------------------------------------------------------------------------

    def anchor(self, level: int) -> str:
        if not level:
            self.mails += 1
            return str(self.mails - 1)
        self.counters += [0] * (level - len(self.counters))
        self.counters[level - 1] += 1
        self.counters[level:] = [0] * (len(self.counters) - level)
        self.counters[:level] = [n or 1 for n in self.counters[:level]]
        return "section" + "".join(f"_{n}" for n in self.counters[:level])

    def anchored(self, text: str, level: int) -> str:
        if not self.opts.make_anchors:
            return text
        name = f'<{self.tags.case("a")} {self.tags.case("name")}="{self.anchor(level)}">'
        return re.sub(r"(<[hH]\d>)(.*)(</[hH]\d>)", lambda m: f"{m.group(1)}{name}{m.group(2)}</{self.tags.case('a')}>{m.group(3)}", text, count=1, flags=re.S)

    def level(self, style: str) -> int:
        """Styles get levels in the order they are met."""
        return self.styles.setdefault(style, len(self.styles) + 1)

    def is_heading(self, text: str, under: str) -> bool:
        if blank(text) or not re.match(r"[ \t\n\r\f\x0b]*[-=*.~+]+[ \t\n\r\f\x0b]*\Z", under):
            return False
        mark = self.mark_of(text)
        if mark and mark.prefix and not mark.number:
            return False
        body, rule = text.lstrip(SPACE), under.strip(SPACE)  # the line feed counts
        shift = lambda s: len(s) - len(s.lstrip(SPACE))
        body = re.sub("&[^;]+;", "X", body)
        return abs(len(body) - len(rule)) <= self.opts.underline_length_tolerance or abs(shift(text) - shift(under)) <= self.opts.underline_offset_tolerance

    def heading(self, text: str, under: str) -> str:
        style = under.strip(SPACE)[0] + ("C" if self.is_caps(text) else "")
        return self._heading(text, self.level(style))

    def custom_heading(self, text: str) -> str:
        at = next(i for i, p in enumerate(self.opts.custom_heading_regexp) if pattern(p).search(text))
        return self._heading(text, at + 1 if self.opts.explicit_headings else self.level(f"custom {at}"))

    def _heading(self, text: str, level: int) -> str:
        text = escape(text) if self.opts.escape_HTML_chars else text
        return self.anchored(self.tags.around(f"H{level}", text), level)

    def is_mail(self, text: str) -> bool:
        return re.search(r"\AFrom:?|Newsgroups: ", text) is not None

    def mail_header(self, rows: list[str]) -> list[str]:
        """Every row but the last ends in a break."""
        self.special = "mail"
        rows = [escape(r) for r in rows] if self.opts.escape_HTML_chars else list(rows)
        if self.opts.make_anchors:
            a, name = self.tags.case("a"), self.tags.case("name")
            rows[0] = re.sub(r"[^ ]*", lambda m: f'<{a} {name}="{self.anchor(0)}">{m.group()}</{a}>', rows[0], count=1)
        opened = self.tags.start("p", " class='mail_header'")
        out = [f"<!-- New Message -->\n{opened}{rows[0].removesuffix(chr(10))}{self.tags.empty('br')}\n"]
        for i, row in enumerate(rows[1:], 1):
            out.append(f"{row.removesuffix(chr(10))}{self.tags.empty('br')}\n" if i + 1 < len(rows) else row)
        return out

    # -- paragraphs -------------------------------------------------------------------------------------------

    def split_lines(self, text: str) -> list[Line]:
        out, indent = [], 0
        for raw in re.findall(LINE, text) or [""]:
            raw = expand_tabs(raw, self.opts.tab_width)
            if not blank(raw):
                indent = len(raw) - len(raw.lstrip(" "))
            out.append(Line(raw, len(raw), indent))
        return out

    def body_of(self, text: str, fragment: bool) -> tuple[str, set[str]]:
        """A paragraph's blocks, and what its last line did."""
        o, rows, done = self.opts, self.split_lines(text), []
        texts = [r.text for r in rows]
        custom = any(pattern(p).search(texts[0]) for p in o.custom_heading_regexp)
        table = tables.kind_of(texts, len(text), o.table_type) if o.make_tables and len(rows) > 1 else None
        titled = not o.explicit_headings and len(rows) > 1 and not table and self.is_heading(texts[0], texts[1])
        mail = o.mailmode and not table and not custom and self.is_mail(texts[0])
        before = Line("", does=set(self.before))
        if self.lists and (table or mail or titled or custom):
            done.append(self.close_lists(len(self.lists)))
            before.does.add("END")
        if self.pre and not self.pre_marked and o.preformat_trigger_lines and (table or mail or not self.looks_preformatted(texts[0])):
            done.append(self.tags.close("pre") + "\n")
            self.pre = False
            before.does.add("END")
        if self.pre:
            done.append("\n")
        if custom:
            done.append(self.custom_heading(rows.pop(0).text))
            before.does.add("HEADER")
        elif titled:
            done.append(self.heading(rows.pop(0).text, rows.pop(0).text))
            before.does.add("HEADER")
        if table and (html := tables.render(table, [r.text for r in rows], len(text), self)):
            self.special, rows = "table", []
            done += html
        if mail and self.special != "table" and rows:
            done += self.mail_header([r.text for r in rows])
            rows = []
        lines = [before, *rows]
        for at in range(1, len(lines)):
            self.line(at, lines, fragment)
            if at == 1 and not blank(before.text):
                lines[1].text = before.text + lines[1].text
        done += [r.text for r in lines[1:]]
        return "".join(done), lines[-1].does if len(lines) > 1 else set()

    def paragraph(self, text: str, close: bool = False, fragment: bool = False) -> str:
        o, self.special, does = self.opts, "", set()
        if o.demoronize and not text.isascii():
            text = text.translate(SMART_TABLE)
        if not o.link_only:
            text = re.sub(r"[ \t]*\r(?=\n?\Z)", "", text) if text.removesuffix("\n").endswith("\r") else text
            text = re.sub(r"\A[ \t]*\r", "", text).replace("\r", "")
            if self.pre_marked:
                # marked text goes on over blank lines until the document ends
                text = escape(text) if o.escape_HTML_chars else text
                text = text.rstrip("\n")
            elif text:
                text, does = self.body_of(text, fragment)
                if self.tags.closes and self.tags.open[-1:] == ["p"]:
                    text += self.tags.close("p")
                if o.unhyphenation and not self.pre and not self.special and re.search(r"[A-Za-z]-\n\s*[A-Za-z]", text):
                    text = HYPHENATED.sub(r"\1\2\4\n\3", text)
                if self.lists or self.pre:
                    text = text.rstrip("\n")
        if not blank(text):
            text = self.inline(text)
        if close:
            text += self.close_lists(len(self.lists))
            while self.tags.closes and self.tags.open:
                text += self.tags.close()
        if not o.eight_bit_clean and not text.isascii():
            text = (text.translate(CODE_TABLE) if o.demoronize else text).translate(ENTITY_TABLE)
        self.before = does | {"LINK"}
        return text

    # -- inline -----------------------------------------------------------------------------------------------

    def inline(self, text: str) -> str:
        if self.rules:
            if self.clue is None or self.clue.search(text.lower()):
                text = links.apply_rules(text, self.rules, self.used, self.used_here, self.opts.lower_case_tags)
            text, dropped = links.scrub(text, self.policy)
            self.dropped += [s for s in dropped if s not in self.dropped]
            if self.opts.no_referrer:
                text = links.with_rel(text)
        for mark, tag in ((self.opts.bold_delimiter, "strong"), (self.opts.italic_delimiter, "em"), (self.opts.underline_delimiter, "u")):
            if mark and mark in text:
                text = delimited(text, mark, self.tags.case(tag), self.opts.lower_case_tags)
        return text

    # -- documents --------------------------------------------------------------------------------------------

    def chunk(self, record: str, close: bool = False, fragment: bool = False) -> str:
        """A record: the parts between its blank lines, each a paragraph."""
        parts = re.split("\r?\n\r?\n", record)
        while parts and not parts[-1]:
            parts.pop()
        if len(parts) == 1:
            return self.paragraph(record, close, fragment)
        return "".join(self.paragraph(p if p.endswith("\n") else p + "\n", close and i + 1 == len(parts)) for i, p in enumerate(parts))

    def record(self, text: str) -> str:
        self.used_here = set()
        return self.chunk(text.removesuffix("\n")) + "\n"

    def finish(self) -> str:
        """What closes the body."""
        out = self.close_lists(len(self.lists))
        if self.pre:
            out += self.tags.close("pre")
        if self.tags.closes and not self.opts.extract and self.tags.open:
            while self.tags.open and self.tags.open[-1] not in ("body", "html"):
                out += self.tags.close()
            out += "\n"
        return out

    def start(self, first: str, append_head: str = "", prepend: str = "", generator: str = "quire") -> str:
        """Everything before the first paragraph."""
        o, t = self.opts, self.tags
        if o.extract:
            return prepend
        out = ""
        if o.doctype:
            if o.xhtml:
                out = '<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN"\n"http://www.w3.org/TR/xhtml1/DTD/xhtml1-strict.dtd">\n' + t.start("html", ' xmlns="http://www.w3.org/1999/xhtml"') + "\n"
            elif o.html5:
                out = "<!DOCTYPE html>\n" + t.start("html", f' {t.case("lang")}="{escape_attr(o.lang)}"' if o.lang else "") + "\n"
            else:
                out = f'<!DOCTYPE HTML PUBLIC "{o.doctype}">\n' + t.start("html") + "\n"
        title = o.title
        if o.titlefirst and not title:
            title = first.split("\n", 1)[0].strip(" ")
            self.title = escape(title) if o.escape_HTML_chars else title
        else:
            self.title = escape_attr(title)
        key = t.case
        metas = [f' {key("name")}="generator" {key("content")}="{generator}"']
        metas += [f' {key("charset")}="utf-8"'] if o.meta_charset or o.html5 else []
        metas += [f' {key("name")}="referrer" {key("content")}="no-referrer"'] if o.no_referrer else []
        opened = t.start("head")
        head = f"{t.start('title')}{self.title}{t.close('title')}\n{append_head}" + "\n".join(t.empty("meta", m) for m in metas) + "\n"
        if o.style_url:
            head += t.empty("link", f' {key("rel")}="stylesheet" {key("type")}="text/css" {key("href")}="{escape_attr(o.style_url)}"') + "\n"
        self.head = head
        return f"{out}{opened}\n{head}{t.close('head')}\n{t.start('body', o.body_deco)}\n{prepend}"

    def tail(self) -> str:
        return "" if self.opts.extract else f"{self.tags.close('body')}\n{self.tags.close('html')}\n"


# Inline marks ----------------------------------------------------------------------------------------------------

WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
PUNCT = r"!-/:-@\[-`{-~"


def replaced(text: str, regex: re.Pattern, accept: Callable[[str, int, int], bool], tag: str, in_link: Callable[[str, str, int], bool] | None = None) -> tuple[str, bool]:
    """(text with each accepted match's first group in an element, whether there was one). After a match that isn't accepted the search goes on one character later; one in a link or tag stays as it is."""
    out, at, kept, any_ = [], 0, 0, False
    while m := regex.search(text, at):
        if not accept(text, m.start(), m.end()):
            at = m.start() + 1
            continue
        out.append(text[kept : m.start()])
        if in_link and in_link(m.group(), text, m.start()):
            out.append(m.group())
        else:
            out.append(f"<{tag}>{m.group(1)}</{tag}>")
            any_ = True
        at = kept = m.end()
    return "".join([*out, text[kept:]]), any_


def delimited(text: str, mark: str, tag: str, lower_case: bool = True) -> str:
    """Text between two marks in an element; each mark has its own idea of what may stand between."""
    char = lambda s, i: s[i] if 0 <= i < len(s) else ""
    flanked = lambda s, a, b: (char(s, a - 1) in WORD and char(s, a - 1) != "") == (mark in WORD) == (char(s, b) in WORD and char(s, b) != "")
    no_block = lambda s, a, b: not re.search("<li>|<LI>|<p>|<P>", s[a + 2 : b - 1])
    anything = lambda s, a, b: True
    in_link = lambda matched, whole, end: links.inside_markup(matched, whole, lower_case, end)
    if mark == "#":
        text, _ = replaced(text, pattern("#([A-Za-z])#"), flanked, tag)
        linked = "<a" in text or "<A" in text
        return replaced(text, pattern(r"#([^\d#][^#]*[^# \t\n])#"), no_block, tag, in_link if linked else None)[0] if "#" in text else text
    if mark == "^":
        text, _ = replaced(text, pattern(r"\^((?:\w|[\"'<>])[^^]*)\^"), lambda s, a, b: not re.search("<li>|<LI>|<p>|<P>", s[a + 1 : b - 1]), tag)
        return replaced(text, pattern(r"\^([A-Za-z])\^"), flanked, tag)[0]
    if mark == "_":
        text, some = replaced(text, pattern("_([A-Za-z])_"), flanked, tag)
        free = lambda s, a, b: char(s, a - 1) not in WORD or char(s, a - 1) == ""
        return replaced(text, pattern(r"_([^_]+?[A-Za-z0-9\"'.?&;:<>])_"), free, tag, None if some else in_link)[0] if "_" in text else text
    if len(mark) == 1:
        d = class_body(mark)
        text, _ = replaced(text, pattern(f"[{d}]([A-Za-z])[{d}]"), flanked, tag)
        return replaced(text, pattern(rf"[{d}]([^{d}]+?[A-Za-z0-9!-/:-@\[-`{{-~&<>])[{d}]"), lambda s, a, b: char(s, a - 1) != mark, tag)[0]
    d = re.escape(mark)
    text, _ = replaced(text, pattern(rf"{d}((?:\w|[\"'])(?:\w|[-\s{PUNCT}])*[^\s]){d}"), lambda s, a, b: not s[:a].endswith(mark), tag)
    return replaced(text, pattern(rf"{d}\]([A-Za-z]){d}"), anything, tag)[0]


def records(text: str) -> list[str]:
    """Records of a whole text; each ends with its first empty line."""
    return re.findall(r"[^\n][^\n]*+(?:\n(?!\n)[^\n]++)*+(?:\n\n|\n?\Z)", text)


def to_html(text: str, options: ConvertOptions | None = None, rules: list[links.Rule] | None = None, whole: bool = False, sides: dict[str, str] | None = None) -> dict[str, str]:
    """start, body and tail of a document's HTML. whole: the text is one record, as strings given by hand are.

    sides: texts that go into the head (append_head), before the body (prepend_file) and after it (append_file)."""
    w, sides = Writer(options, rules), sides or {}
    parts = [text] if whole else records(text)
    start = w.start(parts[0], sides.get("append_head", ""), sides.get("prepend_file", "")) if parts else ""
    body = "".join(w.record(p) for p in parts) + w.finish() + sides.get("append_file", "")
    return {"start": start, "body": body, "tail": w.tail() if parts else "", "title": w.title, "head": w.head, "dropped": ",".join(w.dropped)}
