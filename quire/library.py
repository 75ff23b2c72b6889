"""Templates and presets that come with the engine."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, replace

from pyspark.sql import DataFrame, SparkSession

from quire.functions.templates import NAMESPACE
from quire.options import ConvertOptions, OptionError, TableTypes, find_name, with_value


def _slot(name: str) -> str:
    return "{{" + f"{NAMESPACE}:{name}" + "}}"


def _page(style: str, body: str) -> str:
    return f'<!DOCTYPE html>\n<html lang="{_slot("lang")}">\n<head>\n{_slot("head")}<style>{style}</style>\n</head>\n<body>\n{body}</body>\n</html>\n'


#: name -> (model, html). A document template stands for the whole page; a body template for what is inside body.
TEMPLATES = {
    "article": ("document", _page("main{max-width:40em;margin:auto}", f"{_slot('header')}{_slot('toc')}<main>\n{_slot('content')}</main>\n{_slot('citations')}{_slot('glossary')}")),
    "book": ("document", _page("main{max-width:36em;margin:auto;font-family:serif}article{break-before:page}", f"{_slot('header')}{_slot('toc')}<main>\n{_slot('content')}</main>\n{_slot('pager')}{_slot('citations')}{_slot('glossary')}")),
    "manpage": ("document", _page("body{font-family:monospace;margin:2em}", f"{_slot('header')}<main>\n{_slot('content')}</main>\n")),
    "slide": ("document", _page("article{min-height:100vh}", f"<main>\n{_slot('content')}</main>\n{_slot('pager')}")),
    "readable": ("body", f'<div class="readable">\n{_slot("header")}{_slot("content")}</div>\n'),
    "bare": ("body", _slot("content")),
}

#: name -> options that differ from the defaults.
PRESETS = {
    "default": {},
    "mail": {"mailmode": "true", "short_line_length": "60"},
    "prose": {"short_line_length": "0", "unhyphenation": "true"},
    "tables": {"make_tables": "true"},
    "outline": {"section": "true", "toc": "true", "number_headings": "true"},
    "private": {"no_referrer": "true", "allowed_url_schemes": "https,mailto"},
    "fragment": {"extract": "true"},
    "xhtml": {"xhtml": "true"},
    "notes": {"citations": "true", "glossary": "true"},
}


def templates(spark: SparkSession) -> DataFrame:
    """name, model, html."""
    return spark.createDataFrame([(n, m, h) for n, (m, h) in TEMPLATES.items()], "name string, model string, html string")


def template(name: str) -> tuple[bool, str]:
    """(whether it stands for the whole page, html)."""
    try:
        model, html = TEMPLATES[name]
    except KeyError:
        raise OptionError(f"no template {name!r}; there are {', '.join(TEMPLATES)}") from None
    return model == "document", html


def preset(name: str, own: dict[str, dict] | None = None) -> ConvertOptions:
    """The whole set of options a preset stands for; a user's presets come before these."""
    values = own[name]["options"] if own and name in own else PRESETS.get(name)
    if values is None:
        raise OptionError(f"no preset {name!r}")
    options = ConvertOptions()
    for key, value in values.items():
        options = with_value(options, find_name(key)[0], value)
    return replace(options, preset=name)


def presets(spark: SparkSession) -> DataFrame:
    """name, options as a map."""
    return spark.createDataFrame(list(PRESETS.items()), "name string, options map<string,string>")


def to_json(options: ConvertOptions) -> str:
    """Only what differs from the defaults, by name."""
    base = asdict(ConvertOptions())
    return json.dumps({k: v for k, v in asdict(options).items() if v != base[k]}, sort_keys=True)


def from_json(text: str) -> ConvertOptions:
    data = json.loads(text)
    names = {f.name for f in fields(ConvertOptions)}
    if unknown := set(data) - names:
        raise OptionError(f"unknown options {sorted(unknown)}")
    if "table_type" in data:
        data["table_type"] = TableTypes(**data["table_type"])
    return replace(ConvertOptions(), **{k: tuple(v) if isinstance(v, list) else v for k, v in data.items()})


def describe(options: ConvertOptions) -> str:
    """What a set of options does beyond the defaults, in words."""
    base = ConvertOptions()
    said = []
    for f in fields(ConvertOptions):
        value = getattr(options, f.name)
        if value != getattr(base, f.name):
            words = f.name.replace("_", " ")
            said.append(words if value is True else f"no {words}" if value is False else f"{words}: {value}")
    return "; ".join(said) or "defaults"
