"""Quality rules: a short-circuit cascade, ordered by rejection per cost as estimated on a sample.

The base counts are made for every document, since they are returned. The rules then run in turn on what no
earlier rule has rejected. A bounded sample (`sample` documents of smallest hash, four times as many at most) tells each
rule's cost (the characters it goes through) and selectivity (the share it rejects of what reaches it, after the base and the
rules before it); the rule with the most rejections a cost goes next. Costs are counted, not timed, so reruns have one order.
The sample is read where it lies; a row of numbers a document comes to the driver. The verdict is that no rule rejects, so
it is the same in any order.

Defined cases: null and empty text has no words and fails the base; very long texts are counted whole; an empty table gives an
empty result; with no sample, and in ties, the rules keep the order they are listed in; rows without an id and repeated rows
each get a row; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from quire.llm.common import map_rows

# Fixed values.
SPACE = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
BULLETS = "-*+•‣◦▪·"


class Text:
    """A text and its base counts; rules look at what they need."""

    def __init__(self, text: str | None):
        self.text = text = text or ""
        self.words = text.encode().split()
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(map(text.count, SPACE))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        self.n_lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.n_repeat_words = repeated(self.words)
        self.base_failed = self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    pairs, at = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    if len(pairs) == n - 1:
        return 0
    _, three, counts = np.unique(at[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = (counts > 1)[three]
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


# Each rule says whether it rejects. Bounds are loose: only what is plainly no running text goes.
def mostly_symbols(t: Text) -> bool:
    """Symbols are over 0.3 a word."""
    return 10 * t.n_symbols > 3 * t.n_words


def odd_word_length(t: Text) -> bool:
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


def repeated_lines(t: Text) -> bool:
    """Over half of the lines, four at least, are copies of an earlier one."""
    return t.n_dup_lines >= 4 and 2 * t.n_dup_lines > t.n_lines


def few_letters(t: Text) -> bool:
    """Under two in five of the words' characters are letters."""
    return 5 * sum(map(str.isalpha, t.text)) < 2 * t.word_chars


def shouted(t: Text) -> bool:
    """Over nine in ten letters are capitals and exclamation marks follow over a third of the words."""
    if 3 * t.text.count("!") <= t.n_words:
        return False
    letters = sum(map(str.isalpha, t.text))
    return 10 * sum(map(str.isupper, t.text)) > 9 * letters


def bullets(t: Text) -> bool:
    """Over nine in ten lines, ten at least, begin with a bullet."""
    lines = [x.lstrip(SPACE)[0] for x in t.text.split("\n") if x.strip(SPACE)]
    return len(lines) >= 10 and 10 * sum(x in BULLETS for x in lines) > 9 * len(lines)


RULES: dict[str, Callable[[Text], bool]] = {f.__name__: f for f in (mostly_symbols, odd_word_length, repeated_lines, few_letters, shouted, bullets)}
#: What a rule goes through in a text; one that compares counts of the base goes through nothing.
WORK: dict[str, Callable[[Text], int]] = {
    "mostly_symbols": lambda t: 1,
    "odd_word_length": lambda t: 1,
    "repeated_lines": lambda t: 1,
    "few_letters": lambda t: 1 + len(t.text),
    "shouted": lambda t: 1 + len(t.text) // 16 if 3 * t.text.count("!") <= t.n_words else 1 + 2 * len(t.text),
    "bullets": lambda t: 1 + len(t.text) // 4,
}


def best_order(rejects: np.ndarray, work: np.ndarray) -> list[str]:
    """The rules' names, from documents x rules: whether it rejects, and its cost. Each time the most rejections a cost of what is left."""
    names, order_ = list(RULES), []
    left = np.ones(len(rejects), bool)
    while names:
        at = [list(RULES).index(r) for r in names]
        worth = rejects[left][:, at].sum(0) / np.maximum(1, work[left][:, at].sum(0))
        order_.append(names.pop(int(np.argmax(worth))))
        left &= ~rejects[:, list(RULES).index(order_[-1])]
    return order_


def order(docs: DataFrame, sample: int = 500) -> list[str]:
    """The rules' names in the order of the cascade, from a sample of documents that the base lets through."""
    n = docs.select("doc_id").count()
    chosen = F.pmod(F.xxhash64(F.lit("quality"), "doc_id", F.length("text")), F.lit(1 << 30)) < min(1.0, sample / max(1, n)) * (1 << 30)
    schema = StructType([StructField("rejects", ArrayType(BooleanType())), StructField("work", ArrayType(LongType()))])

    def run(texts):
        read = [t for t in map(Text, texts) if not t.base_failed]
        return {"rejects": [[f(t) for f in RULES.values()] for t in read], "work": [[WORK[r](t) for r in RULES] for t in read]}

    rows = map_rows(docs.where(chosen).select("text").limit(4 * sample), ["text"], run, schema).collect()
    shape = (len(rows), len(RULES))
    return best_order(np.array([r["rejects"] for r in rows], bool).reshape(shape), np.array([r["work"] for r in rows], np.int64).reshape(shape))


def judge(docs: DataFrame, rules: list[str]) -> DataFrame:
    """doc_id, base counts, base_failed, kept."""
    own = docs.select("doc_id").schema["doc_id"]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = StructType([own, *[StructField(c, LongType()) for c in counts], StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])

    def run(ids, texts):
        read = [Text(t) for t in texts]
        kept = [not t.base_failed and not any(RULES[r](t) for r in rules) for t in read]  # any() stops at the first that rejects
        return {own.name: ids, "kept": kept} | {c: [getattr(t, c) for t in read] for c in (*counts, "base_failed")}

    return map_rows(docs, ["doc_id", "text"], run, schema)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs, order(docs))
