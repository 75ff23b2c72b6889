"""Runs of text in another script than the document's language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import chars


def _within(code: int, ranges) -> bool:
    return any(a <= code <= b for a, b in ranges)


def kind(char: str) -> str:
    """cjk, a language code, latin, other or neutral; as chars.script_kind, for one character."""
    code = ord(char)
    if _within(code, chars.HAN + chars.KANA + chars.HANGUL + chars.CJK_MARKS):
        return "cjk"
    for low, high, language in chars.SCRIPTS:
        if low <= code <= high:
            return language
    if _within(code, chars.LATIN):
        return "latin"
    return "other" if char.isalpha() else "neutral"


def cjk_language(run: str) -> str:
    """Kana say Japanese, hangul Korean, ideographs alone Chinese."""
    if any(_within(ord(c), chars.KANA) for c in run):
        return "ja"
    return "ko" if any(_within(ord(c), chars.HANGUL) for c in run) else "zh"


def runs(text: str) -> list[tuple[str, str]]:
    """(kind, text) of neighbouring characters of a kind; neutral ones join a run only between two parts of it."""
    found: list[tuple[str, str]] = []
    for c in text:
        k = kind(c)
        if found and found[-1][0] == k:
            found[-1] = (k, found[-1][1] + c)
        elif len(found) > 1 and found[-1][0] == "neutral" and found[-2][0] == k and k not in ("latin", "other"):
            gap = found.pop()
            found[-1] = (k, found[-1][1] + gap[1] + c)
        else:
            found.append((k, c))
    return found


def wrap(html: str, language: str) -> str:
    """Runs of a foreign script in <span lang>; tags are copied, and letters whose language can't be told are left."""
    import re

    own = re.split("[-_]", language)[0].lower()
    out = []
    for piece in re.findall(r"<[^>]*>?|[^<]+", html):
        if piece.startswith("<"):
            out.append(piece)
            continue
        for k, run in runs(piece):
            tag = cjk_language(run) if k == "cjk" else k
            out.append(run if k in ("latin", "other", "neutral") or tag == own else f'<span lang="{tag}">{run}</span>')
    return "".join(out)


def histogram(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, kind, n: characters by script. Characters are counted by value first, so kinds are found once a character."""
    seen = docs.select(*keys, F.explode(F.split("text", "")).alias("c")).where("c != ''").groupBy(*keys, "c").count()
    return seen.groupBy(*keys, chars.script_kind(F.col("c")).alias("kind")).agg(F.sum("count").alias("n"))


def run_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, run_no, kind, text: runs of neighbouring characters of one kind, as gaps and islands."""
    order = Window.partitionBy(key).orderBy("pos")
    rows = docs.select(key, F.posexplode(F.split("text", "")).alias("pos", "c")).where("c != ''").withColumn("kind", chars.script_kind(F.col("c")))
    starts = rows.withColumn("new", F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1)))
    marked = starts.withColumn("run_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "")
    return marked.groupBy(key, "run_no").agg(F.first("kind").alias("kind"), text.alias("text"))
