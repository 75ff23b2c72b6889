"""Tables in plain text: which kind rows make, and their HTML."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from quire.options import TableTypes

if TYPE_CHECKING:
    from quire.operators.machine import Writer

RULE = re.compile(r"[ \t\n\r\f\x0b]*\+-+\+-+\+[-+]*(?=\n?\Z)", re.A)
GUTTER = re.compile(r"(?:^| ) +(?=[^ ])")


def _after_caption(rows: list[str], sign: str = r"\|") -> tuple[str, list[str]]:
    """(caption, rows): a first row of words without the sign is a caption."""
    return (rows[0], rows[1:]) if not re.search(sign, rows[0], re.A) and re.match(r"\s*\w", rows[0], re.A) else ("", rows)


def is_pgsql(rows: list[str]) -> bool:
    body = _after_caption(rows)[1]
    tests = ((0, r"\s*\w+\s+\|\s"), (1, r"\s*-+\+-"), (2, r"\s*[^|]*\s\|\s"))
    return len(rows) >= 4 and len(body) >= 4 and all(re.match(p, body[i], re.A) for i, p in tests) and bool(re.search(r"\(\d+\s+rows\)", body[-1], re.A))


def is_border(rows: list[str]) -> bool:
    body = _after_caption(rows)[1]
    if len(rows) < 5 or len(body) < 5 or not all(RULE.match(body[i]) for i in (0, 2, -1)):
        return False
    return bool(re.match(r"\s*\|\s*\w+\s+\|\s.*\|(?=\n?\Z)", body[1], re.A | re.S) and re.match(r"\s*\|\s*[^|]*\s\|\s.*\|(?=\n?\Z)", body[3], re.A | re.S))


def is_delim(rows: list[str]) -> bool:
    body = _after_caption(rows, r"[^\w\s]")[1]
    m = re.match(r"\s*([^A-Za-z0-9])", body[0], re.A) if len(body) > 1 else None
    if not m or m.group(1) in "^[]\\" or body[0].count(m.group(1)) < 3:
        return False
    sign = m.group(1)
    return all(r.strip().startswith(sign) and r.strip().endswith(sign) and r.count(sign) == body[0].count(sign) for r in body)


def spaces(rows: list[str]) -> str:
    """A space where every row has one, by bytes, as far as the shortest row goes."""
    raw = [r.encode() for r in rows]
    return "".join(" " if all(c == 32 for c in column) else "X" for column in zip(*raw))


def columns(rows: list[str]) -> list[tuple[int, int]]:
    """(start, end) of each column, by bytes."""
    shape = spaces(rows)
    gaps = [m.span() for m in GUTTER.finditer(shape)]
    starts = ([] if shape.startswith(" ") else [0]) + [b for _, b in gaps]
    ends = [a for a, _ in gaps][1 if shape.startswith(" ") and gaps else 0 :] + [max(len(r.encode()) for r in rows)]
    return list(zip(starts, ends))


def is_aligned(rows: list[str]) -> bool:
    return len(rows) >= 2 and len(columns(rows)) >= 2


def kind_of(rows: list[str], length: int, kinds: TableTypes) -> str | None:
    """The first kind, in this order, that the rows make."""
    if kinds.delim and is_delim(rows):
        return "delim"
    if kinds.align and is_aligned(rows):
        return "align"
    if kinds.pgsql and is_pgsql(rows):
        return "pgsql"
    return "border" if kinds.border and is_border(rows) else None


def _cut(row: str, start: int, end: int) -> str:
    """Bytes start to end of a row; empty where they don't make whole characters."""
    try:
        return row.encode()[start:end].decode()
    except UnicodeDecodeError:
        return ""


def alignments(rows: list[str], spans: list[tuple[int, int]]) -> list[str]:
    """left, right, center or none of each column: what over half of its cells say that don't fill it."""
    out = []
    for start, end in spans:
        votes = {"left": 0, "right": 0, "center": 0}
        for row in rows:
            cell = _cut(row, start, end)
            before, after = cell.startswith(" "), cell.endswith(" ") or len(cell.encode()) < end - start
            if before or after:
                votes["center" if before and after else "right" if before else "left"] += 1
        out.append(next((k for k, n in votes.items() if 2 * n > sum(votes.values())), "none"))
    return out


def cells(row: str, sign: str) -> list[str]:
    """A row's cells between signs; one at either end is the frame's."""
    return row.strip("\n").lstrip(" \t").removeprefix(sign).removesuffix(sign).split(sign)


def _shown(text: str, w: Writer) -> str:
    from quire.operators.machine import escape

    text = escape(text.strip()) if w.opts.escape_HTML_chars else text.strip()
    return "&nbsp;" if text in ("0", "") else text


def _row(w: Writer, items: list[str], tag: str = "td", attributes: list[str] | None = None) -> str:
    opened = w.tags.start("tr")
    body = "".join(w.tags.start(tag, attributes[i] if attributes else "") + c + w.tags.close(tag) for i, c in enumerate(items))
    return opened + body + w.tags.close("tr")


def _framed(w: Writer, caption: str, heads: list[str] | None, body: list[list[str]]) -> list[str]:
    out = [w.tags.start("table", ' border="1"' + (' summary=""' if w.opts.xhtml else "")) + "\n"]
    if caption:
        out.append(f"{w.tags.start('caption')}{caption.strip()}{w.tags.close('caption')}\n")
    if heads is not None:
        opened = w.tags.start("thead")
        out.append(f"{opened}{_row(w, heads, 'th')}{w.tags.close('thead')}\n")
        out.append(w.tags.start("tbody") + "\n")
    out += [_row(w, [_shown(c, w) for c in row]) + "\n" for row in body]
    if heads is not None:
        out.append(w.tags.close("tbody") + "\n")
    return [*out, w.tags.end("table") + "\n"]


def render(kind: str, rows: list[str], length: int, w: Writer) -> list[str]:
    """The rows of a table as HTML lines; empty if they turn out not to be one."""
    from quire.operators.machine import escape

    if kind == "align":
        spans = columns(rows)
        if len(rows) < 2 or len(spans) < 2:
            return []
        how = alignments(rows, spans)
        o = w.opts

        def attribute(a: str) -> str:
            if a not in ("right", "center"):
                return ""
            if o.xhtml:
                return f' style="text-align: {a};"'
            return f' class="align-{a}"' if o.html5 else f' {w.tags.case("align")}="{w.tags.case(a)}"'

        out = []
        for row in rows:
            items = [_cut(row, a, b).strip(" ") for a, b in spans]
            out.append(_row(w, [escape(c) if o.escape_HTML_chars else c for c in items], "td", [attribute(a) for a in how]))
        out[0] = w.tags.start("table", ' summary=""' if o.xhtml else "") + "\n" + out[0]
        out[-1] += "\n" + w.tags.close("table")
        return out
    if kind == "delim":
        caption, body = _after_caption(rows)
        sign = re.match(r"\s*([^A-Za-z0-9])", body[0], re.A).group(1)
        return _framed(w, caption, None, [cells(r, sign) for r in body])
    caption, body = _after_caption(rows)
    heads = lambda row: [h for h in (x.strip() for x in re.split(r"\s+\|\s+", row)) if h]
    if kind == "border":
        return _framed(w, caption, heads(body[1].lstrip(" \t").removeprefix("|").removesuffix("|")), [cells(r, "|") for r in body[3:-1]])
    out = _framed(w, caption, heads(body[0]), [r.split("|") for r in body[2:-1]])
    last, _, rest = (w.tags.start("p") + body[-1] + "\n").partition("\n")
    return [*out, last + (w.tags.end("p") if w.tags.closes else "") + "\n" + rest]
