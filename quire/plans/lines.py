"""Queries over single lines, rows and names, most of them derived from the relational tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import chars, decode, predicates, templates
from quire.operators import catalog, convert, links, nodes, records, scripts, sections
from quire.options import ConvertOptions
from quire.plans.structure import _packs
from quire.plans.text import ESCAPES, _nested, long, table


def mail_quotes(spark, sf_dir):
    """Lines that are quotes and end in a break, since one follows that isn't blank; whether they open a quote."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(records.lines(F.concat(F.when(F.col("turn") % 2 == 0, "").otherwise("> "), F.replace("text", F.lit(". "), F.lit(".\n> "))))).alias("n", "line"))
    order = Window.partitionBy("conv_id", "turn").orderBy("n")
    rows = own.withColumn("next", F.lead("line").over(order)).withColumn("quote", predicates.is_mail_quote(chars.escape(F.col("line"))) & F.coalesce(~predicates.is_blank(F.col("next")), F.lit(False)))
    rows = rows.withColumn("opens", F.col("quote") & ~F.coalesce(F.lag("quote").over(order), F.lit(False)))
    return rows.groupBy("conv_id", "turn").agg(long(F.count_if("quote")).alias("quotes"), long(F.count_if("opens")).alias("opens"))


MAIL_QUOTES_SQL = rf"""
WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '' ELSE '> ' END || replace(text, '. ', '.' || chr(10) || '> ') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) AS n FROM t),
q AS (SELECT *, regexp_matches({_nested('line', ESCAPES)}, '^(?:\w*&gt|[|:])') AND coalesce(NOT regexp_full_match(lead(line) OVER (PARTITION BY conv_id, turn ORDER BY n), '[ \t\n\r\f\v]*'), false) AS quote FROM l),
o AS (SELECT *, quote AND NOT coalesce(lag(quote) OVER (PARTITION BY conv_id, turn ORDER BY n), false) AS opens FROM q)
SELECT conv_id, turn, count(*) FILTER (quote) AS quotes, count(*) FILTER (opens) AS opens FROM o GROUP BY ALL
"""


def items(spark, sf_dir):
    """Marks of list items, of every kind: prefix, number, term and the width of it all."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("- ", "12) ", "a. ", "o ", "* ", "x")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    line = F.concat(F.expr("repeat(' ', int(p_partkey % 4))"), mark, F.col("p_brand"))
    own = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    found = predicates.list_prefix(F.col("line"))
    return own.select("p_partkey", found["prefix"].alias("prefix"), found["number"].alias("number"), found["term"].alias("term"), long(F.length(predicates.total_prefix(F.col("line")))).alias("width"))


ITEMS_SQL = r"""
WITH m AS (SELECT p_partkey, repeat(' ', CAST(p_partkey % 4 AS INT)) AS pad, ['- ', '12) ', 'a. ', 'o ', '* ', 'x'][p_partkey % 6 + 1] AS mark, p_brand FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN '' WHEN 1 THEN pad || ')' WHEN 2 THEN pad || '.' ELSE pad || mark END AS prefix,
  CASE p_partkey % 6 WHEN 1 THEN '12' WHEN 2 THEN 'a' ELSE '' END AS number, '' AS term,
  length(regexp_extract(pad || mark || p_brand, '^(\s*[\w\-=o*·]*.?\s*)', 1)) AS width FROM m
"""

PATTERNS = ("^1-", "^[23]-", "URGENT")


def custom_headings(spark, sf_dir):
    """Which of several patterns makes an order's priority a heading, and its level by that order."""
    first = F.array_position(F.array(*[F.col("o_orderpriority").rlike(p) for p in PATTERNS]), True)
    return table(spark, sf_dir, "orders").where(predicates.is_custom_heading(F.col("o_orderpriority"), PATTERNS)).groupBy(long(first).alias("level")).agg(long(F.count("*")).alias("n"))


CUSTOM_SQL = "SELECT CAST(CASE WHEN o_orderpriority LIKE '1-%' THEN 1 WHEN regexp_matches(o_orderpriority, '^[23]-') THEN 2 ELSE 3 END AS BIGINT) AS level, count(*) AS n FROM orders WHERE regexp_matches(o_orderpriority, '^[123]-|URGENT') GROUP BY 1"


PLAIN = ConvertOptions(extract=True, make_links=False, make_anchors=False)


def caps_lines(spark, sf_dir):
    """Paragraphs of one line, some in capitals, converted: which come out in their element."""
    line = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, " 12!").otherwise(" & CO"))
    return convert.to_html(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat(line, F.lit("\n")).alias("text")), PLAIN).select("doc_id", F.trim(F.regexp_replace("html", r"\s+", " ")).alias("html"))


CAPS_SQL = """
WITH l AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || CASE WHEN c_custkey % 2 = 0 THEN ' 12!' ELSE ' &amp; CO' END AS line, c_custkey % 3 <> 0 AS caps, c_custkey FROM customer)
SELECT doc_id, CASE WHEN caps AND c_custkey % 2 = 0 THEN '<p><strong>' || line || '</strong> </p>' ELSE '<p>' || line || '</p>' END AS html FROM l
"""


def table_cells(spark, sf_dir):
    """Delimited rows converted to a table: frame signs go, an empty cell or 0 is shown as a hard space."""
    text = F.concat(F.lit("|"), "n_name", F.lit("| |"), F.col("n_regionkey").cast("string"), F.lit("|\n|a & b|x|0|\n"))
    done = convert.to_html(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), text.alias("text")), replace(PLAIN, make_tables=True))
    cells = F.regexp_extract_all("html", F.lit(r"(?s)<td>(.*?)</td>"), F.lit(1))
    return done.select(F.col("doc_id").alias("n_nationkey"), F.posexplode(cells).alias("col", "cell")).select("n_nationkey", long(F.col("col")).alias("col"), "cell")


CELLS_SQL = "SELECT n_nationkey, unnest([0, 1, 2, 3, 4, 5]) AS col, unnest([n_name, '&nbsp;', CASE WHEN n_regionkey = 0 THEN '&nbsp;' ELSE CAST(n_regionkey AS VARCHAR) END, 'a &amp; b', 'x', '&nbsp;']) AS cell FROM nation"


def dropped_schemes(spark, sf_dir):
    """A user's links as HTML, without the refused ones, whose schemes are said once each, in the order met."""
    url = F.element_at(F.array(*[F.lit(x) for x in ("javascript:x", "https://ok/", " DATA:y", "file:///z", "/here")]), (F.col("event_id") % 5 + 1).cast("int"))
    anchor = F.concat(F.lit('<a href="'), url, F.lit('">t'), F.col("event_id").cast("string"), F.lit("</a> "))
    own = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", anchor.alias("a")))), lambda x: x["a"]), "").alias("html"))
    return links.scrubbed(own).select(F.col("doc_id").alias("user_id"), "dropped", F.md5(F.col("html").cast("binary")).alias("md5"))


DROPPED_SQL = """
WITH e AS (SELECT user_id, event_id, ['javascript', NULL, 'data', 'file', NULL][event_id % 5 + 1] AS scheme, CASE event_id % 5 WHEN 1 THEN '<a href="https://ok/">' WHEN 4 THEN '<a href="/here">' END AS opened FROM events),
f AS (SELECT user_id, scheme, min(event_id) AS first FROM e WHERE scheme IS NOT NULL GROUP BY ALL), d AS (SELECT user_id, string_agg(scheme, ',' ORDER BY first) AS dropped FROM f GROUP BY user_id),
h AS (SELECT user_id, string_agg(coalesce(opened, '') || 't' || event_id || CASE WHEN opened IS NULL THEN '' ELSE '</a>' END || ' ', '' ORDER BY event_id) AS html FROM e GROUP BY user_id)
SELECT h.user_id, coalesce(dropped, '') AS dropped, md5(html) AS md5 FROM h LEFT JOIN d ON h.user_id = d.user_id
"""


def worst_encoding(spark, sf_dir):
    """The encoding of each user's inputs that most needs saying."""
    names = ("utf-8", "cp1252", "utf-16le")
    rank = F.create_map(*[F.lit(x) for n in names for x in (n, decode.RANKS[n])])
    own = table(spark, sf_dir, "events").select("user_id", F.element_at(F.array(*map(F.lit, names)), F.when(F.col("event_id") % 17 == 0, 3).when(F.col("event_id") % 5 == 0, 2).otherwise(1)).alias("encoding"))
    return own.groupBy("user_id").agg(F.max_by("encoding", rank[F.col("encoding")]).alias("encoding"))


WORST_SQL = "WITH e AS (SELECT user_id, CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS r FROM events) SELECT user_id, ['utf-8', 'cp1252', 'utf-16le'][max(r) + 1] AS encoding FROM e GROUP BY user_id"


def chunk_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", sections.basename(F.lower("n_name"), F.col("n_nationkey").cast("int")).alias("name"), chars.primary_language(F.concat(F.substring("n_name", 1, 2), F.lit("-Latn"))).alias("lang"))


NAMES_SQL = "SELECT n_nationkey, format('{}-chunk-{:02d}.html', lower(n_name), n_nationkey) AS name, lower(substr(n_name, 1, 2)) AS lang FROM nation"


def safe_paths(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/b.html", "/etc/x", "a/../b", "..", "c:x", "a..b/c")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", templates.is_safe_path(path).alias("safe"), templates.is_note_key(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("key"))


SAFE_SQL = r"SELECT p_partkey, p_partkey % 6 IN (0, 5) AS safe, regexp_full_match(replace(p_brand, '#', '.'), '[A-Za-z0-9._-]+') AS key FROM part"


def problems(spark, sf_dir):
    """Lines of an engine's message with the line they name."""
    message = F.concat(F.lit("file.txt:"), F.col("s_suppkey").cast("string"), F.lit(": bad tag\n\nsee line "), (F.col("s_suppkey") * 2).cast("string"), F.lit("\nno number"))
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(nodes.problem_lines(message)).alias("n", "p"))
    return own.select("s_suppkey", long(F.col("n")).alias("n"), long(F.col("p.line")).alias("line"), F.col("p.text").alias("text"))


PROBLEMS_SQL = "SELECT s_suppkey, unnest([0, 1, 2]) AS n, unnest([s_suppkey, s_suppkey * 2, NULL]) AS line, unnest(['file.txt:' || s_suppkey || ': bad tag', 'see line ' || (s_suppkey * 2), 'no number']) AS text FROM supplier"


def listing(spark, sf_dir):
    return catalog.listing(_packs(spark, sf_dir), "id", "name", "version")


LISTING_SQL = """SELECT '{"id":"org.nation' || s_nationkey || '","name":"' || s_name || '","version":"' || (s_suppkey % 3) || '.' || (s_suppkey % 11) || '"}' AS json FROM supplier"""


def script_runs(spark, sf_dir):
    """Runs of one script in part names, some of them with other letters."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " 漢字 ").when(F.col("p_partkey") % 3 == 1, "Ελ").otherwise(""), F.lit("z"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), name.alias("text"))
    return scripts.run_table(own).groupBy("doc_id", "kind").agg(long(F.count("*")).alias("runs"), long(F.sum(F.length("text"))).alias("n_chars"))


RUNS_SQL = r"""
WITH t AS (SELECT p_partkey AS doc_id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' 漢字 ' WHEN 1 THEN 'Ελ' ELSE '' END || 'z' AS text FROM part),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t),
k AS (SELECT doc_id, i, CASE WHEN c IN ('漢', '字') THEN 'cjk' WHEN c IN ('Ε', 'λ') THEN 'el' WHEN regexp_matches(c, '[A-Za-z]') THEN 'latin' ELSE 'neutral' END AS kind FROM c WHERE c <> ''),
s AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i) <> kind, true) AS new FROM k)
SELECT doc_id, kind, count(*) FILTER (new) AS runs, count(*) AS n_chars FROM s GROUP BY ALL
"""


def mail_headers(spark, sf_dir):
    """Mails converted: every row of a header paragraph but the last ends in a break."""
    text = F.concat(F.lit("From: "), "c_name", F.lit("\nSubject: "), "c_mktsegment", F.lit(" & more\nDate: today\n\nthe body of it\n"))
    done = convert.to_html(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text")), replace(PLAIN, mailmode=True))
    return done.select(F.col("doc_id").alias("c_custkey"), F.regexp_replace(F.regexp_extract("html", r"(?s)(<!-- New.*?)</p>", 1), r"\s+", " ").alias("html"))


HEADERS_SQL = "SELECT c_custkey, '<!-- New Message --> <p class=''mail_header''>From: ' || c_name || '<br> Subject: ' || c_mktsegment || ' &amp; more<br> Date: today ' AS html FROM customer"

QUERIES = {
    "q12_mail_quotes": (mail_quotes, MAIL_QUOTES_SQL),
    "q13_items": (items, ITEMS_SQL),
    "q15_custom_headings": (custom_headings, CUSTOM_SQL),
    "q23_caps_lines": (caps_lines, CAPS_SQL),
    "q28_script_runs": (script_runs, RUNS_SQL),
    "q54_dropped_schemes": (dropped_schemes, DROPPED_SQL),
    "q55_worst_encoding": (worst_encoding, WORST_SQL),
    "q56_chunk_names": (chunk_names, NAMES_SQL),
    "q57_table_cells": (table_cells, CELLS_SQL),
    "q58_mail_headers": (mail_headers, HEADERS_SQL),
    "q59_problems": (problems, PROBLEMS_SQL),
    "q60_listing": (listing, LISTING_SQL),
    "q61_safe_paths": (safe_paths, SAFE_SQL),
}
