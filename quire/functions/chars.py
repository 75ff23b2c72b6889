"""Character-level Column functions: escaping, smart punctuation, entities, scripts."""

from __future__ import annotations

from html.entities import codepoint2name

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smart punctuation and its plain form, in the order of replacement.
SMART = (
    ("‚", ","), ("„", ",,"), ("…", "..."), ("ˆ", "^"), ("‹", "<"), ("Œ", "Oe"), ("‘", "`"), ("’", "'"),
    ("“", '"'), ("”", '"'), ("•", "*"), ("–", "-"), ("—", "--"), ("›", ">"), ("œ", "oe"),
)
CODES = (("ƒ", "<em>f</em>"), ("˜", "<sup>~</sup>"), ("™", "<sup>TM</sup>"))

#: Named entities of U+00A1 to U+00FF; the macron has the name this engine has always given it.
ENTITIES = {chr(c): f"&{'hibar' if c == 0xAF else codepoint2name[c]};" for c in range(0xA1, 0x100)}

# Scripts that one language is by far the most usual for, as (first, last, language).
SCRIPTS = (
    (0x0370, 0x03FF, "el"), (0x0530, 0x058F, "hy"), (0x0590, 0x05FF, "he"), (0x0900, 0x097F, "hi"), (0x0980, 0x09FF, "bn"), (0x0A00, 0x0A7F, "pa"), (0x0A80, 0x0AFF, "gu"),
    (0x0B80, 0x0BFF, "ta"), (0x0C00, 0x0C7F, "te"), (0x0C80, 0x0CFF, "kn"), (0x0D00, 0x0D7F, "ml"), (0x0D80, 0x0DFF, "si"), (0x0E00, 0x0E7F, "th"), (0x0E80, 0x0EFF, "lo"),
    (0x0F00, 0x0FFF, "bo"), (0x1000, 0x109F, "my"), (0x10A0, 0x10FF, "ka"), (0x1200, 0x137F, "am"), (0x13A0, 0x13FF, "chr"), (0x1800, 0x18AF, "mn"),
)
HAN = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF))
KANA = ((0x3040, 0x309F), (0x30A0, 0x30FF), (0xFF65, 0xFF9F))
HANGUL = ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7A3))
CJK_MARKS = ((0x3000, 0x303F), (0xFF00, 0xFFEF))
LATIN = ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    return _replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")))


def escape_attr(text: Column) -> Column:
    return _replaced(escape(text), (('"', "&quot;"),))


def demoronize(text: Column) -> Column:
    """Smart punctuation to plain; single characters in one pass, longer forms after it."""
    single = [p for p in SMART if len(p[1]) == 1]
    text = F.translate(text, "".join(a for a, _ in single), "".join(b for _, b in single))
    return _replaced(text, [p for p in SMART if len(p[1]) > 1])


def demoronize_codes(text: Column) -> Column:
    return _replaced(text, CODES)


def entities(text: Column) -> Column:
    """Latin-1 letters and signs as named entities; texts without any are left alone at once."""
    return F.when(text.rlike("[¡-ÿ]"), _replaced(text, ENTITIES.items())).otherwise(text)


def in_ranges(code: Column, ranges) -> Column:
    test = F.lit(False)
    for low, high in ranges:
        test = test | code.between(low, high)
    return test


def code_point(char: Column) -> Column:
    """The code point of a one-character string, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("int")


def single_script_language(code: Column) -> Column:
    test = None
    for low, high, language in SCRIPTS:
        test = F.when(code.between(low, high), language) if test is None else test.when(code.between(low, high), language)
    return test


def script_kind(char: Column) -> Column:
    """cjk, a language code, latin, other (another letter) or neutral."""
    code = code_point(char)
    return (
        F.when(in_ranges(code, HAN + KANA + HANGUL + CJK_MARKS), "cjk")
        .when(single_script_language(code).isNotNull(), single_script_language(code))
        .when(in_ranges(code, LATIN), "latin")
        .when(char.rlike(r"^\p{IsAlphabetic}$"), "other")
        .otherwise("neutral")
    )


def primary_language(tag: Column) -> Column:
    return F.lower(F.element_at(F.split(tag, "[-_]"), 1))
