"""Conversion options: one immutable record, its names and aliases, checks, presets, option files and arguments."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, fields, replace


class OptionError(ValueError):
    """An option that can't be used, alone or beside another."""


@dataclass(frozen=True)
class TableTypes:
    align: bool = True
    pgsql: bool = True
    border: bool = True
    delim: bool = True


@dataclass(frozen=True)
class ConvertOptions:
    allowed_url_schemes: str | None = None
    append_file: str = ""
    append_head: str = ""
    body_deco: str = ""
    bold_delimiter: str = "#"
    bullets: str = "-=o*·"
    bullets_ordered: str = ""
    caps_tag: str = "STRONG"
    chunk: bool = False
    chunk_chars: int = 0
    citations: bool = False
    close_optional_tags: bool = True
    custom_heading_regexp: tuple[str, ...] = ()
    default_link_dict: str = ""
    demoronize: bool = True
    doctype: str = '-//W3C//DTD HTML 4.01//EN"\n"http://www.w3.org/TR/html4/strict.dtd'
    document_template: str = ""
    eight_bit_clean: bool = False
    escape_HTML_chars: bool = True
    explicit_headings: bool = False
    extract: bool = False
    hrule_min: int = 4
    html5: bool = True
    glossary: bool = False
    indent_width: int = 2
    indent_par_break: bool = False
    infile: tuple[str, ...] = ()
    instring: tuple[str, ...] = ()
    lang: str = "en"
    lang_runs: bool = False
    italic_delimiter: str = "*"
    encoding: str = "auto"
    meta_charset: bool = False
    links_dictionaries: tuple[str, ...] = ()
    link_only: bool = False
    list_templates: bool = False
    lower_case_tags: bool = True
    mailmode: bool = False
    make_anchors: bool = True
    make_links: bool = True
    make_tables: bool = False
    min_caps_length: int = 3
    no_referrer: bool = False
    number_headings: bool = False
    outfile: str = "-"
    par_indent: int = 2
    preformat_trigger_lines: int = 2
    endpreformat_trigger_lines: int = 2
    preformat_start_marker: str = "^(:?(:?&lt;)|<)PRE(:?(:?&gt;)|>)$"
    preformat_end_marker: str = "^(:?(:?&lt;)|<)/PRE(:?(:?&gt;)|>)$"
    preformat_whitespace_min: int = 5
    prepend_file: str = ""
    preserve_indent: bool = False
    preset: str = ""
    report: bool = False
    section: bool = False
    section_chars: int = 0
    short_line_length: int = 40
    stream: bool = False
    style_url: str = ""
    tab_width: int = 8
    table_type: TableTypes = field(default_factory=TableTypes)
    body_template: str = ""
    template_dir: tuple[str, ...] = ()
    catalog_dir: tuple[str, ...] = ()
    template_library: str = ""
    title: str = ""
    titlefirst: bool = False
    toc: bool = False
    underline_delimiter: str = "_"
    underline_length_tolerance: int = 1
    underline_offset_tolerance: int = 1
    unhyphenation: bool = True
    utf8: bool = True
    use_mosaic_header: bool = False
    use_preformat_marker: bool = False
    var: tuple[str, ...] = ()
    xhtml: bool = False


NAMES = tuple(f.name for f in fields(ConvertOptions))

# Other spellings of options.
ALIASES = {
    "url_schemes": "allowed_url_schemes",
    "append_body": "append_file",
    "ab": "append_file",
    "ah": "append_head",
    "capstag": "caps_tag",
    "ct": "caps_tag",
    "notes": "citations",
    "heading": "custom_heading_regexp",
    "H": "custom_heading_regexp",
    "dict": "default_link_dict",
    "dt": "doctype",
    "8": "eight_bit_clean",
    "escapechars": "escape_HTML_chars",
    "ec": "escape_HTML_chars",
    "EH": "explicit_headings",
    "r": "hrule_min",
    "iw": "indent_width",
    "ipb": "indent_par_break",
    "wrap_langs": "lang_runs",
    "enc": "encoding",
    "link": "links_dictionaries",
    "l": "links_dictionaries",
    "linkonly": "link_only",
    "LO": "link_only",
    "lc_tags": "lower_case_tags",
    "LC": "lower_case_tags",
    "m": "mailmode",
    "anchors": "make_anchors",
    "tables": "make_tables",
    "caps": "min_caps_length",
    "c": "min_caps_length",
    "out": "outfile",
    "o": "outfile",
    "prebegin": "preformat_trigger_lines",
    "pb": "preformat_trigger_lines",
    "preend": "endpreformat_trigger_lines",
    "pe": "endpreformat_trigger_lines",
    "prewhite": "preformat_whitespace_min",
    "p": "preformat_whitespace_min",
    "prepend_body": "prepend_file",
    "pp": "prepend_file",
    "pi": "preserve_indent",
    "shortline": "short_line_length",
    "s": "short_line_length",
    "tabwidth": "tab_width",
    "tw": "tab_width",
    "template": "body_template",
    "t": "title",
    "tf": "titlefirst",
    "ulength": "underline_length_tolerance",
    "ul": "underline_length_tolerance",
    "uoffset": "underline_offset_tolerance",
    "uo": "underline_offset_tolerance",
    "unhyphenate": "unhyphenation",
    "mosaic": "use_mosaic_header",
    "mh": "use_mosaic_header",
    "preformat_marker": "use_preformat_marker",
    "pm": "use_preformat_marker",
}

# Encodings by any spelling.
ENCODINGS = {
    "auto": "auto", "utf-8": "utf-8", "utf8": "utf-8", "cp1252": "cp1252", "windows-1252": "cp1252", "latin-1": "latin-1", "latin1": "latin-1", "iso-8859-1": "latin-1",
    "cp1251": "cp1251", "windows-1251": "cp1251", "cp1253": "cp1253", "windows-1253": "cp1253", "koi8-r": "koi8-r", "koi8r": "koi8-r",
    "utf-16le": "utf-16le", "utf-16be": "utf-16be", "utf-32le": "utf-32le", "utf-32be": "utf-32be", "utf16le": "utf-16le", "utf16be": "utf-16be", "utf32le": "utf-32le", "utf32be": "utf-32be",
}

RANGES = {"tab_width": (1, 999), "indent_width": (0, 999), "preformat_whitespace_min": (0, 999), "hrule_min": (0, 999), "min_caps_length": (0, 999)}


def encoding(name: str) -> str:
    """The encoding of this name; case and _ for - don't matter."""
    try:
        return ENCODINGS[name.strip().lower().replace("_", "-")]
    except KeyError:
        raise OptionError(f"unknown encoding {name!r}") from None


def kind(name: str) -> str:
    default = getattr(ConvertOptions(), name)
    return "flag" if isinstance(default, bool) else "int" if isinstance(default, int) else "list" if isinstance(default, tuple) else "table" if isinstance(default, TableTypes) else "str"


def find_name(spelling: str) -> tuple[str, bool]:
    """(option, whether it is switched off) of a spelling: alias, no-form of a flag, or the start of one name only."""
    plain = spelling.replace("-", "_")

    def exact(s: str) -> str | None:
        return s if s in NAMES else ALIASES.get(s)

    if found := exact(plain):
        return found, False
    for prefix in ("no_", "no"):
        if plain.startswith(prefix) and (found := exact(plain[len(prefix) :])) and kind(found) == "flag":
            return found, True
    starts = {exact(s) for s in (*NAMES, *ALIASES) if len(s) > 2 and s.startswith(plain)}
    if len(starts) == 1:
        return starts.pop(), False
    raise OptionError(f"{'ambiguous' if starts else 'unknown'} option {spelling!r}")


def table_types(text: str, now: TableTypes | None) -> TableTypes:
    """KEY or KEY=0|1, comma-separated. The first setting turns all types off before."""
    now = now or TableTypes(False, False, False, False)
    for part in filter(None, text.split(",")):
        key, _, value = part.partition("=")
        if key.lower() not in ("align", "pgsql", "border", "delim"):
            raise OptionError(f"unknown table type {key!r}")
        now = replace(now, **{key.lower(): value not in ("0",)})
    return now


def with_value(options: ConvertOptions, name: str, value: str | bool) -> ConvertOptions:
    """The options with one more setting, in the way of its kind; tag case follows html5 and xhtml."""
    how = kind(name)
    if how == "flag":
        on = value if isinstance(value, bool) else {"1": True, "on": True, "true": True, "yes": True, "0": False, "off": False, "false": False, "no": False}.get(value.lower())
        if on is None:
            raise OptionError(f"{name}: not a flag value: {value!r}")
        options = replace(options, **{name: on})
        if name == "html5":
            options = replace(options, xhtml=options.xhtml and not on, lower_case_tags=on)
        if name == "xhtml":
            options = replace(options, html5=False, lower_case_tags=on)
        return options
    if how == "int":
        if not re.fullmatch(r"\d+", str(value)):
            raise OptionError(f"{name}: not a number: {value!r}")
        return replace(options, **{name: int(value)})
    if how == "list":
        return replace(options, **{name: (*getattr(options, name), str(value))})
    if how == "table":
        first = options.table_type == TableTypes()
        return replace(options, table_type=table_types(str(value), None if first else options.table_type))
    return replace(options, **{name: encoding(str(value)) if name == "encoding" else str(value)})


def settled(options: ConvertOptions) -> ConvertOptions:
    """Clamped values, and what follows from others."""
    begin, end = min(2, options.preformat_trigger_lines), min(2, options.endpreformat_trigger_lines)
    if begin == 0:
        end = 1
    options = replace(options, preformat_trigger_lines=begin, endpreformat_trigger_lines=end)
    if options.xhtml:
        options = replace(options, html5=False, lower_case_tags=True)
    return options


def check(options: ConvertOptions) -> None:
    """Raises OptionError for values out of range and settings that exclude each other."""
    for name, (low, high) in RANGES.items():
        if not low <= getattr(options, name) <= high:
            raise OptionError(f"{name} must be between {low} and {high}")
    for pattern in (*options.custom_heading_regexp, options.preformat_start_marker, options.preformat_end_marker):
        try:
            re.compile(pattern)
        except re.error as why:
            raise OptionError(f"bad pattern {pattern!r}: {why}") from None
    on = {n for n in ("extract", "chunk", "section", "toc", "stream", "instring", "citations", "glossary", "lang_runs", "report", "number_headings", "chunk_chars", "section_chars") if getattr(options, n)}
    refused = {
        "chunk_chars": {"extract", "chunk", "section", "toc", "stream", "instring", "section_chars", "lang_runs", "citations", "glossary"},
        "section_chars": {"chunk", "section", "stream", "extract"},
        "stream": {"report", "instring", "chunk", "section", "toc", "number_headings", "lang_runs", "citations", "glossary"},
        "chunk": {"citations", "glossary"},
    }
    for name, others in refused.items():
        if name in on and others & on:
            raise OptionError(f"{name} can't go with {', '.join(sorted(others & on))}")
    if options.chunk_chars and options.outfile in ("", "-"):
        raise OptionError("chunk_chars needs an output file")
    if not re.fullmatch("[A-Za-z0-9-]*", options.lang):
        raise OptionError(f"lang: not a language tag: {options.lang!r}")
    if options.stream and options.encoding not in ("auto", "utf-8"):
        raise OptionError("stream reads UTF-8 only")
    templates = [t for t in (options.document_template, options.body_template, options.template_library) if t]
    if len(templates) > 1:
        raise OptionError("one template at a time")
    if templates and on & {"extract", "chunk", "stream"}:
        raise OptionError("a template can't go with extract, chunk or stream")
    for v in options.var:
        name, equals, _ = v.partition("=")
        if not equals or not re.fullmatch("[A-Za-z0-9_-]+", name):
            raise OptionError(f"var: not name=value: {v!r}")


def variables(options: ConvertOptions) -> dict[str, str]:
    return dict(v.split("=", 1) for v in options.var)


def from_arguments(arguments: Sequence[str], start: ConvertOptions | None = None) -> ConvertOptions:
    """--name value, --name=value, --flag, --noflag; -- and plain words are input files."""
    options, rest, i = start or ConvertOptions(), [], 0
    while i < len(arguments):
        word = arguments[i]
        i += 1
        if word == "--":
            rest += arguments[i:]
            break
        if not word.startswith("-") or word == "-":
            rest.append(word)
            continue
        spelled, equals, value = word.lstrip("-").partition("=")
        name, off = find_name(spelled)
        if kind(name) == "flag":
            options = with_value(options, name, (value if equals else True) if not off else False)
        else:
            if not equals:
                if i >= len(arguments):
                    raise OptionError(f"{name} needs a value")
                value = arguments[i]
                i += 1
            options = with_value(options, name, value)
    return replace(options, infile=(*options.infile, *rest))


def option_file(text: str) -> list[str]:
    """The words of an option file: comments go, quotes hold words together; a line without a dash gets one."""
    words: list[str] = []
    for line in text.splitlines():
        parts = shlex.split(line, comments=True)
        if parts and not parts[0].startswith("-"):
            parts[0] = f"--{parts[0]}"
        words += parts
    return words


def layered(files: Iterable[str], preset: dict[str, str] | None, arguments: Sequence[str]) -> ConvertOptions:
    """Option files in order, then a preset, then arguments: the later wins."""
    options = ConvertOptions()
    for text in files:
        options = from_arguments(option_file(text), options)
    for name, value in (preset or {}).items():
        options = with_value(options, find_name(name)[0], value)
    options = settled(from_arguments(arguments, options))
    check(options)
    return options


def last_preset(arguments: Sequence[str]) -> str:
    """The preset that arguments ask for; the last one counts."""
    found = ""
    for i, word in enumerate(arguments):
        if word == "--preset" and i + 1 < len(arguments):
            found = arguments[i + 1]
        elif word.startswith("--preset="):
            found = word.partition("=")[2]
    return found


def toml_value(text: str) -> str | int | bool | list[str]:
    """A string, whole number, flag or list of strings of the strict subset that presets and manifests use."""
    import tomllib

    try:
        value = tomllib.loads(f"v = {text}")["v"]
    except tomllib.TOMLDecodeError as why:
        raise OptionError(str(why)) from None
    if isinstance(value, float) or not isinstance(value, (str, int, bool, list)) or isinstance(value, list) and not all(isinstance(x, str) for x in value):
        raise OptionError(f"value of a kind that isn't used here: {text!r}")
    return value


def presets(text: str) -> dict[str, dict]:
    """key -> {name, description, options} from a presets file; unknown keys are refused."""
    import tomllib

    found = {}
    for key, own in tomllib.loads(text).items():
        if not isinstance(own, dict) or set(own) - {"name", "description", "options"}:
            raise OptionError(f"preset {key!r} has unknown keys")
        values = {}
        for name, value in own.get("options", {}).items():
            find_name(name)
            values[name] = str(value).lower() if isinstance(value, bool) else str(value)
        found[key] = {"name": own.get("name", key), "description": own.get("description", ""), "options": values}
    return found
