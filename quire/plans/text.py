"""Queries over documents: lines, characters, encodings, links in text. Each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quire.functions import chars, decode, html, predicates, templates
from quire.operators import links, records, scripts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c):
    return c.cast("long")


def count_lines(test):
    """How many lines of an array fit; test takes a line, or a line and its place. Counted inside the row, so nothing is shuffled."""
    return long(F.size(F.filter("lines", test)))


def structure_report(spark, sf_dir):
    """Per document: lines, short-line breaks, capitals lines, blank lines, characters, bytes."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", records.lines(F.col("text")).alias("lines"))

    def breaks(line, i):
        before = F.get("lines", i - 1)
        return F.coalesce((F.length(before) < 40) & ~predicates.is_blank(before) & ~predicates.is_blank(line), F.lit(False))

    return own.select(
        "doc_id", long(F.size("lines")).alias("n_lines"), count_lines(breaks).alias("n_breaks"), count_lines(lambda x: predicates.is_caps(x)).alias("n_caps"), count_lines(predicates.is_blank).alias("n_blank"),
        long(F.length("text")).alias("n_chars"), long(F.octet_length("text")).alias("n_bytes"),
    )


BLANK_SQL = r"regexp_full_match({0}, '[ \t\n\r\f\v]*')"

STRUCTURE_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS n FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM l)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (NOT {BLANK_SQL.format('line')} AND NOT {BLANK_SQL.format('before')} AND length(before) < 40) AS n_breaks,
  count(*) FILTER (regexp_full_match(line, '[^a-z<]*[A-Z]{{3,}}[^a-z<]*', 's')) AS n_caps,
  count(*) FILTER ({BLANK_SQL.format('line')}) AS n_blank,
  CAST(sum(length(line)) AS BIGINT) AS n_chars, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes
FROM p GROUP BY doc_id
"""


def lines(spark, sf_dir):
    return records.exploded_lines(table(spark, sf_dir, "documents")).select("doc_id", long(F.col("line_no")).alias("line_no"), F.md5(F.col("line").cast("binary")).alias("line_md5"), long(F.col("len")).alias("len"), long(F.col("indent")).alias("indent"))


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no, md5(line) AS line_md5, length(line) AS len, CAST(length(regexp_extract(line, '^( *)', 1)) AS BIGINT) AS indent FROM l
"""


def paragraphs(spark, sf_dir):
    """Conversations as texts with blank lines between turns, split again."""
    turns = table(spark, sf_dir, "conversations")
    texts = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text"))
    return texts.select("doc_id", F.posexplode(records.paragraphs(F.col("text"))).alias("para_no", "paragraph")).select("doc_id", long(F.col("para_no")).alias("para_no"), "paragraph")


PARAGRAPHS_SQL = r"""
WITH t AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
s AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n\r?\n') AS parts FROM t),
k AS (SELECT doc_id, parts, coalesce(list_max(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN parts[i] <> '' THEN i ELSE 0 END)), 0) AS n FROM s)
SELECT doc_id, generate_subscripts(parts[1:n], 1) - 1 AS para_no, unnest(parts[1:n]) AS paragraph FROM k
"""


def _per_text(expression):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(expression(F.col("text")).cast("binary")).alias("md5"), long(F.length(expression(F.col("text")))).alias("n_chars"))

    return run


def _per_text_sql(expression: str) -> str:
    return f"WITH e AS (SELECT doc_id, {expression} AS t FROM documents) SELECT doc_id, md5(t) AS md5, length(t) AS n_chars FROM e"


def _nested(text: str, pairs) -> str:
    for old, new in pairs:
        text = f"replace({text}, '{old}', '{new.replace(chr(39), chr(39) * 2)}')"
    return text


ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def line_predicates(spark, sf_dir):
    """How many lines of each document look like a rule, preformatted text, a list item, a mail header, a quote."""
    own = table(spark, sf_dir, "documents").select("doc_id", records.lines(F.coalesce("text", F.lit(""))).alias("lines"))
    tests = {"n_rules": lambda x: predicates.is_hrule(x), "n_pre": lambda x: predicates.is_preformatted(x), "n_items": lambda x: predicates.list_prefix(x)["prefix"] != "", "n_mail": predicates.is_mail_header, "n_quotes": lambda x: predicates.is_mail_quote(chars.escape(x))}
    return own.select("doc_id", *[count_lines(t).alias(n) for n, t in tests.items()])


PREDICATES_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line FROM documents)
SELECT doc_id,
  count(*) FILTER (regexp_matches(line, '^\s*(?:[-_~=*]\s*){{4,}}\z')) AS n_rules,
  count(*) FILTER (regexp_matches(line, '\s{{5}}\S|\.{{5}}\S')) AS n_pre,
  count(*) FILTER (regexp_matches(line, '^\s*[-=o*·]\s+\S|^\s*(?:\d+|[A-Za-z_])[.)\]:]\s+\S|^\s*\w\w+:\n?\z')) AS n_items,
  count(*) FILTER (regexp_matches(line, '^From|Newsgroups: ')) AS n_mail,
  count(*) FILTER (regexp_matches({_nested('line', ESCAPES)}, '^(?:\w*&gt|[|:])')) AS n_quotes
FROM l GROUP BY doc_id
"""

MAIL = r"[A-Za-z0-9_+\-.]+@[A-Za-z0-9][\w.+\-]+\.[A-Za-z]{2,}"
NUMBER = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
RFC = r"[Rr][Ff][Cc] ?\d+"


def text_links(spark, sf_dir):
    """Matches of three rules, in one reading of the texts."""
    found = [F.struct(F.lit(label).alias("rule"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("all")) for label, pattern in (("mail", MAIL), ("number", NUMBER), ("rfc", RFC))]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*found)).alias("r"))
    return rows.select("r.rule", "doc_id", F.posexplode("r.all").alias("pos", "found")).select("rule", "doc_id", long(F.col("pos")).alias("pos"), "found")


TEXT_LINKS_SQL = "\nUNION ALL\n".join(rf"SELECT '{k}' AS rule, doc_id, generate_subscripts(regexp_extract_all(text, '{p}'), 1) - 1 AS pos, unnest(regexp_extract_all(text, '{p}')) AS found FROM documents" for k, p in (("mail", MAIL), ("number", NUMBER), ("rfc", RFC)))


def rule_candidates(spark, sf_dir):
    """How many documents each built-in link rule may match, by its literals."""
    rules = links.rules_frame(spark, links.load_rules()[0]).where("literals is not null")
    return links.candidate_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).groupBy("label").agg(long(F.count("*")).alias("n_docs"))


def _candidates_sql() -> str:
    rows = [(r.label, r.literals) for r in links.load_rules()[0] if r.literals]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(label)}, [{', '.join(map(quote, lits))}])" for label, lits in rows)
    return f"WITH r(label, literals) AS (VALUES {values}) SELECT label, count(*) AS n_docs FROM documents, r WHERE len(list_filter(literals, lambda x: contains(lower(text), x))) > 0 GROUP BY label"


def script_histogram(spark, sf_dir):
    return scripts.histogram(table(spark, sf_dir, "documents"), "lang").select("lang", "kind", long(F.col("n")).alias("n_chars"))


def _between(column: str, ranges) -> str:
    return "(" + " OR ".join(f"{column} BETWEEN {a} AND {b}" for a, b in ranges) + ")"


SCRIPT_SQL = f"""
WITH c AS (SELECT lang, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT lang, c, unicode(c) AS u, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL)
SELECT lang, CASE WHEN {_between('u', chars.HAN + chars.KANA + chars.HANGUL + chars.CJK_MARKS)} THEN 'cjk'
  {' '.join(f"WHEN u BETWEEN {a} AND {b} THEN '{k}'" for a, b, k in chars.SCRIPTS)}
  WHEN {_between('u', chars.LATIN)} THEN 'latin' WHEN regexp_full_match(c, '\\pL') THEN 'other' ELSE 'neutral' END AS kind, CAST(sum(n) AS BIGINT) AS n_chars
FROM n GROUP BY ALL
"""


def delim_tables(spark, sf_dir):
    """Documents whose lines with bars make a table once they are framed, and their cells."""
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))).alias("rows"))
    framed = rows.select("doc_id", F.transform("rows", lambda r: F.concat(F.lit("|"), F.trim(r), F.lit("|"))).alias("rows"))
    cells = F.aggregate("rows", F.lit(0), lambda a, r: a + F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))) - 1)
    return framed.select("doc_id", long(F.size("rows")).alias("n_rows"), long(cells).alias("n_cells"), predicates.is_delim_table(F.col("rows")).alias("is_table"))


DELIM_SQL = r"""
WITH r AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: '|' || trim(x, ' ') || '|') AS rows FROM documents WHERE contains(text, '|')),
n AS (SELECT doc_id, rows, list_transform(rows, lambda x: length(x) - length(replace(x, '|', ''))) AS bars FROM r)
SELECT doc_id, len(rows) AS n_rows, CAST(list_sum(list_transform(bars, lambda b: b - 1)) AS BIGINT) AS n_cells,
  len(rows) >= 2 AND bars[1] >= 3 AND len(list_distinct(bars)) = 1 AS is_table FROM n
"""


def rollup(spark, sf_dir):
    counted = html.counts(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("lang", "source", *[c.alias(n) for n, c in counted.items()])
    return docs.rollup("lang", "source").agg(long(F.count("*")).alias("n_docs"), *[long(F.sum(n)).alias(n) for n in counted])


ROLLUP_SQL = r"""
SELECT lang, source, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
  CAST(sum(len(regexp_extract_all(text, '(?i)<h[1-6]'))) AS BIGINT) AS headings, CAST(sum(len(regexp_extract_all(text, '(?i)<p[>\s]'))) AS BIGINT) AS paragraphs,
  CAST(sum(len(regexp_extract_all(text, '(?i)<strong'))) AS BIGINT) AS strong, CAST(sum(len(regexp_extract_all(text, '(?i)<br'))) AS BIGINT) AS br
FROM documents GROUP BY ROLLUP (lang, source)
"""


def encodings(spark, sf_dir):
    """Texts as bytes, as they are and in Latin-1: validity, marks, and the single-byte tables natively."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    return raw.select(
        "doc_id", decode.is_utf8(F.col("b")).alias("is_utf8"), F.coalesce(decode.mark_of(F.col("b")), F.lit("")).alias("mark"), F.md5(decode.decode_single(F.col("b"), "latin-1").cast("binary")).alias("latin1_md5"),
        decode.representable(F.col("b").cast("string"), "latin-1").alias("fits_latin1"),
    )


ENCODINGS_SQL = r"""
SELECT doc_id, true AS is_utf8, CASE WHEN starts_with(hex(encode(text)), 'EFBBBF') THEN 'utf-8' ELSE '' END AS mark,
  md5(list_aggregate(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: chr(CAST('0x' || h AS INTEGER))), 'string_agg', '')) AS latin1_md5,
  NOT regexp_matches(text, '[^\x01-\x{ff}]') AS fits_latin1
FROM documents
"""


#: encoding -> (a word it can hold, its bytes as hexadecimal digits)
SAMPLES = {"latin-1": ("Grüße", "4772FCDF65"), "cp1252": ("“naïve”", "936E61EF766594"), "cp1251": ("Привет", "CFF0E8E2E5F2"), "cp1253": ("Γειά", "C3E5E9DC"), "koi8-r": ("Привет", "F0D2C9D7C5D4")}


def all_encodings(spark, sf_dir):
    """Names as bytes in every encoding, found by mark, by zero bytes or by name, read back and written again."""
    own = table(spark, sf_dir, "part").where("p_name is not null").select("p_partkey", F.concat("p_name", F.lit(" é漢字")).alias("text"))
    utf16 = lambda order: F.encode("text", f"UTF-16{order}")
    wide = F.encode(F.concat(F.lit("plain "), "text"), "UTF-16LE")
    turned = F.unhex(F.regexp_replace(F.hex(F.encode("text", "UTF-32")), "(..)(..)(..)(..)", "$4$3$2$1"))
    kinds = {"utf-8": F.encode("text", "UTF-8"), "utf-16le": F.concat(F.lit(b"\xff\xfe"), utf16("LE")), "utf-16be": F.concat(F.lit(b"\xfe\xff"), utf16("BE")), "utf-32le": F.concat(F.lit(b"\xff\xfe\x00\x00"), turned), "utf-32be": F.concat(F.lit(b"\x00\x00\xfe\xff"), F.encode("text", "UTF-32")), "zeros": wide, "fallback": F.concat(F.encode("p_partkey", "UTF-8"), F.lit(b"\x93\xef\x94"))}
    marked = own.select("p_partkey", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("content")) for k, c in kinds.items()])).alias("s")).select("p_partkey", "s.*")
    found = marked.select("p_partkey", "kind", decode.decode(F.col("content")).alias("d")).select("p_partkey", "kind", "d.text", "d.encoding")
    for name, (_, digits) in SAMPLES.items():
        content = F.concat(F.encode(F.col("p_partkey").cast("string"), "US-ASCII"), F.unhex(F.lit(digits)))
        named = own.select("p_partkey", F.lit("named " + name).alias("kind"), decode.decode(content, name).alias("d")).select("p_partkey", "kind", "d.text", "d.encoding")
        found = found.unionByName(named)
    return found


ALL_ENCODINGS_SQL = (
    "WITH t AS (SELECT p_partkey, p_name || ' é漢字' AS text FROM part WHERE p_name IS NOT NULL)\n"
    + "\nUNION ALL ".join(f"SELECT p_partkey, '{k}' AS kind, text, '{k}' AS encoding FROM t" for k in ("utf-8", "utf-16le", "utf-16be", "utf-32le", "utf-32be"))
    + "\nUNION ALL SELECT p_partkey, 'zeros', 'plain ' || text, 'utf-16le' FROM t\nUNION ALL SELECT p_partkey, 'fallback', p_partkey || '“ï”', 'cp1252' FROM t"
    + "".join(f"\nUNION ALL SELECT p_partkey, 'named {n}', p_partkey || '{w}', '{n}' FROM t" for n, (w, _) in SAMPLES.items())
)


def unhyphenated(spark, sf_dir):
    """Texts broken after every hundredth character inside a word, put together again."""
    broken = F.regexp_replace("text", r"([A-Za-z]{4})([A-Za-z]{4}) ", "$1-\n$2 ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(predicates.unhyphenated(broken).cast("binary")).alias("md5"))


UNHYPHENATED_SQL = r"""
WITH b AS (SELECT doc_id, regexp_replace(text, '([A-Za-z]{4})([A-Za-z]{4}) ', '\1-' || chr(10) || '\2 ', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '(\s*)([A-Za-z]*)-\n(\s*)([A-Za-z]+[''").,:;}>]*\s*)', '\1\2\4' || chr(10) || '\3', 'g')) AS md5 FROM b
"""


def positions(spark, sf_dir):
    """Where each document's first capital X or digit stands, as line and column."""
    at = F.regexp_instr("text", F.lit("[0-9X]")) - 1
    return table(spark, sf_dir, "documents").select("doc_id", "text", at.alias("idx")).where("idx >= 0").select("doc_id", long(F.col("idx")).alias("idx"), templates.line_col(F.col("text"), F.col("idx")).alias("p")).select("doc_id", "idx", "p.line", "p.col")


POSITIONS_SQL = r"""
WITH p AS (SELECT doc_id, text, length(regexp_extract(text, '^([^0-9X]*)[0-9X]', 1)) AS idx FROM documents WHERE regexp_matches(text, '[0-9X]'))
SELECT doc_id, idx, 1 + length(substr(text, 1, idx)) - length(replace(substr(text, 1, idx), chr(10), '')) AS line, 1 + length(regexp_extract(substr(text, 1, idx), '([^\n]*)\z', 1)) AS col FROM p
"""


def fuzzy(spark, sf_dir):
    return table(spark, sf_dir, "part").where(templates.fuzzy(F.col("p_name"), "aei")).select("p_partkey", templates.slug(F.col("p_name")).alias("slug"))


FUZZY_SQL = r"SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part WHERE regexp_matches(lower(p_name), '(?s)a.*?e.*?i')"

QUERIES = {
    "q01_structure_report": (structure_report, STRUCTURE_SQL),
    "q03_counts_rollup": (rollup, ROLLUP_SQL),
    "q04_escape": (_per_text(chars.escape), _per_text_sql(_nested("text", ESCAPES))),
    "q05_escape_attr": (_per_text(chars.escape_attr), _per_text_sql(_nested("text", (*ESCAPES, ('"', "&quot;"))))),
    "q06_demoronize": (_per_text(lambda t: chars.demoronize_codes(chars.demoronize(t))), _per_text_sql(_nested("text", (*chars.SMART, *chars.CODES)))),
    "q07_entities": (_per_text(chars.entities), _per_text_sql(_nested("text", chars.ENTITIES.items()))),
    "q08_lines": (lines, LINES_SQL),
    "q09_paragraphs": (paragraphs, PARAGRAPHS_SQL),
    "q10_line_predicates": (line_predicates, PREDICATES_SQL),
    "q21_text_links": (text_links, TEXT_LINKS_SQL),
    "q26_rule_prefilter": (rule_candidates, _candidates_sql()),
    "q27_script_histogram": (script_histogram, SCRIPT_SQL),
    "q29_delim_tables": (delim_tables, DELIM_SQL),
    "q32_unhyphenate": (unhyphenated, UNHYPHENATED_SQL),
    "q48_encodings": (encodings, ENCODINGS_SQL),
    "q48_all_encodings": (all_encodings, ALL_ENCODINGS_SQL),
    "q49_line_col": (positions, POSITIONS_SQL),
    "q50_fuzzy_slug": (fuzzy, FUZZY_SQL),
}
