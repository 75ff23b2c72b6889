"""Queries over structure: headings, sections, contents, pages, notes, templates, catalogs, conversion.

The driver's documents have no headings or notes, so these derive structured text from the relational tables, the same
way in both languages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import predicates
from quire.functions import templates as T
from quire.operators import catalog, convert, notes, records, sections
from quire.options import ConvertOptions, TableTypes
from quire.plans.text import long, table
from quire.session import shared_dir


def bodies(spark, sf_dir):
    """A body for each region: a line before, the region, and its nations as headings of three levels."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    level = (F.col("n_nationkey") % 3 + 1).cast("string")
    line = F.concat(F.lit("<h"), level, F.lit(">"), "n_name", F.lit(" <b>x</b></h"), level, F.lit(">\n<p>nation "), F.col("n_nationkey").cast("string"), F.lit("</p>\n"))
    own = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("v")))), lambda x: x["v"]), "").alias("lines"))
    return own.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("<p>"), "r_name", F.lit("</p>\n"), "lines").alias("html"))


SECTIONS_CTE = r"""
WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS ord, CAST(n_nationkey % 3 + 1 AS BIGINT) AS level, n_name || ' x' AS label,
  '<h' || (n_nationkey % 3 + 1) || '>' || n_name || ' <b>x</b></h' || (n_nationkey % 3 + 1) || '>' || chr(10) || '<p>nation ' || n_nationkey || '</p>' || chr(10) AS html FROM nation),
s AS (SELECT doc_id, ord, level, 'chunk-' || ord AS id, label, html FROM n UNION ALL SELECT r_regionkey, 0, NULL, NULL, '', '<p>' || r_name || '</p>' || chr(10) FROM region)
"""


def section_rows(spark, sf_dir):
    return sections.sections(bodies(spark, sf_dir)).select("doc_id", long(F.col("ord")).alias("ord"), long(F.col("level")).alias("level"), "id", "label", "html")


SECTION_ROWS_SQL = SECTIONS_CTE + "SELECT * FROM s"


def heading_numbers(spark, sf_dir):
    own = sections.sections(bodies(spark, sf_dir)).where("ord > 0").select("doc_id", "ord", "level")
    return sections.numbers(own).select("doc_id", long(F.col("ord")).alias("ord"), "number")


NUMBERS_SQL = SECTIONS_CTE + r"""
, g AS (SELECT doc_id, ord, level, count(*) FILTER (level < 2) OVER w AS g2, count(*) FILTER (level < 3) OVER w AS g3, count(*) FILTER (level = 1) OVER w AS c1 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
c AS (SELECT *, count(*) FILTER (level = 2) OVER (PARTITION BY doc_id, g2 ORDER BY ord) AS c2, count(*) FILTER (level = 3) OVER (PARTITION BY doc_id, g3 ORDER BY ord) AS c3 FROM g)
SELECT doc_id, ord, concat_ws('.', CASE WHEN c1 > 0 THEN c1 END, CASE WHEN level >= 2 AND c2 > 0 THEN c2 END, CASE WHEN level >= 3 AND c3 > 0 THEN c3 END) AS number FROM c
"""


def contents(spark, sf_dir):
    return sections.contents(sections.sections(bodies(spark, sf_dir)))


CONTENTS_SQL = SECTIONS_CTE + r"""
SELECT doc_id, '<nav class="toc" id="toc">' || chr(10) || '<ol class="toc-list">' || chr(10) || string_agg('<li class="toc-h' || level || '"><a href="#' || id || '">' || label || '</a></li>' || chr(10), '' ORDER BY ord) || '</ol>' || chr(10) || '</nav>' || chr(10) AS toc
FROM s WHERE ord > 0 GROUP BY doc_id
"""


def sectioned(spark, sf_dir):
    return sections.sectioned(sections.sections(bodies(spark, sf_dir)))


SECTIONED_SQL = SECTIONS_CTE + r"""
SELECT doc_id, string_agg(CASE WHEN ord > 0 THEN '<article class="section" id="' || id || '">' || chr(10) || html || '</article>' || chr(10) ELSE html END, '' ORDER BY ord) AS html FROM s GROUP BY doc_id
"""


def pages(spark, sf_dir):
    paged = sections.with_pager(sections.pages(sections.sections(bodies(spark, sf_dir))), F.concat(F.lit("r"), F.col("doc_id").cast("string")))
    return paged.select("doc_id", long(F.col("page_no")).alias("page_no"), "id", "name", "pager", F.md5(F.col("html").cast("binary")).alias("md5"))


PAGES_CTE = SECTIONS_CTE + r"""
, t AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS top FROM s),
p AS (SELECT *, greatest(count(*) FILTER (level = top) OVER (PARTITION BY doc_id ORDER BY ord), 1) AS page_no FROM t),
g AS (SELECT doc_id, page_no, max(CASE WHEN level = top THEN id END) AS id, max(CASE WHEN level = top THEN label END) AS label, max(top) AS level, string_agg(html, '' ORDER BY ord) AS html, format('r{}-chunk-{:02d}.html', doc_id, page_no) AS name FROM p GROUP BY doc_id, page_no)
"""

PAGES_SQL = PAGES_CTE + r"""
SELECT doc_id, page_no, id, name, md5(html) AS md5,
  '<nav class="pager" aria-label="Parts">' || chr(10)
  || coalesce('<a href="' || lag(name) OVER w || '" rel="prev">&#8592; part ' || (page_no - 1) || '</a>' || chr(10), '')
  || coalesce('<a href="' || lead(name) OVER w || '" rel="next">part ' || (page_no + 1) || ' &#8594;</a>' || chr(10), '') || '</nav>' || chr(10) AS pager
FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)
"""


def page_contents(spark, sf_dir):
    return sections.page_contents(sections.pages(sections.sections(bodies(spark, sf_dir))), F.concat(F.lit("r"), F.col("doc_id").cast("string")))


PAGE_CONTENTS_SQL = PAGES_CTE + r"""
SELECT doc_id, '<nav class="toc" id="toc">' || chr(10) || '<ol class="toc-list">' || chr(10) || string_agg('<li class="toc-h' || level || '"><a href="' || name || '#' || id || '">' || label || '</a></li>' || chr(10), '' ORDER BY page_no) || '</ol>' || chr(10) || '</nav>' || chr(10) AS toc
FROM g WHERE id IS NOT NULL GROUP BY doc_id
"""


def titles(spark, sf_dir):
    """Orders' priorities as underlined titles: which are headings, their style and its level."""
    orders = table(spark, sf_dir, "orders")
    mark = F.element_at(F.array(*[F.lit(c) for c in "=-*~"]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = orders.select((F.col("o_custkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("ord"), F.concat(F.repeat(F.lit(" "), (F.col("o_orderkey") % 3).cast("int")), "o_orderpriority", F.lit("\n")).alias("line"), F.concat(F.expr("repeat(' ', int(o_orderkey % 5))"), F.expr("repeat(element_at(array('=', '-', '*', '~'), int(o_orderkey % 4 + 1)), int(5 + o_orderkey % 9))")).alias("under"), mark.alias("style"))
    found = rows.withColumn("is_heading", predicates.is_heading(F.col("line"), F.col("under")))
    return sections.heading_levels(found.where("is_heading")).select("doc_id", "ord", "style", long(F.col("level")).alias("level"))


TITLES_SQL = r"""
WITH r AS (SELECT o_custkey % 50 AS doc_id, o_orderkey AS ord, repeat(' ', CAST(o_orderkey % 3 AS INT)) || o_orderpriority || chr(10) AS line, CAST(o_orderkey % 5 AS INT) AS off, CAST(5 + o_orderkey % 9 AS INT) AS n, ['=', '-', '*', '~'][o_orderkey % 4 + 1] AS style FROM orders),
h AS (SELECT * FROM r WHERE abs(length(ltrim(line, ' ')) - n) <= 1 OR abs(length(line) - length(ltrim(line, ' ')) - off) <= 1),
f AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, style) AS first FROM h)
SELECT doc_id, ord, style, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS level FROM f
"""


def marked(spark, sf_dir):
    """Bodies with note markers from line items: references, and definitions of some."""
    rows = table(spark, sf_dir, "lineitem")
    key = F.concat(F.lit("k"), (F.col("l_partkey") % 7).cast("string"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "gloss").otherwise("cite")
    mark = F.when(F.col("l_quantity") < 30, F.concat(F.lit("{{quire:"), kind, F.lit(":"), key, F.lit("}}"))).otherwise(F.concat(F.lit("{{quire:def:"), kind, F.lit(":"), key, F.lit("}}x{{/quire:def:"), kind, F.lit(":"), key, F.lit("}}")))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", mark.alias("m"))
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["m"]), " ").alias("html"))


def note_numbers(spark, sf_dir):
    return notes.numbered(notes.markers(marked(spark, sf_dir))).groupBy("doc_id", "kind", "note").agg(long(F.max("number")).alias("number"), long(F.count("*")).alias("refs"), long(F.count_if("first")).alias("firsts"))


NOTES_CTE = r"""
WITH m AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'gloss' ELSE 'cite' END AS kind, 'k' || (l_partkey % 7) AS note, l_quantity < 30 AS is_ref, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem)
"""

NOTE_NUMBERS_SQL = NOTES_CTE + ", f AS (SELECT doc_id, kind, note, min(pos) AS first, count(*) AS refs FROM m WHERE is_ref GROUP BY ALL) SELECT doc_id, kind, note, dense_rank() OVER (PARTITION BY doc_id, kind ORDER BY first) AS number, refs, CAST(1 AS BIGINT) AS firsts FROM f"


def note_problems(spark, sf_dir):
    return notes.problems(notes.markers(marked(spark, sf_dir)))


NOTE_PROBLEMS_SQL = NOTES_CTE + r"""
, g AS (SELECT doc_id, kind, note, count(*) FILTER (is_ref) AS refs, count(*) FILTER (NOT is_ref) AS defs FROM m GROUP BY ALL)
SELECT doc_id, kind, note, CASE WHEN defs = 0 THEN 'undefined' WHEN refs = 0 THEN 'unreferenced' ELSE 'defined twice' END AS problem FROM g WHERE defs = 0 OR refs = 0 OR defs > 1
"""


def filled(spark, sf_dir):
    """A template filled for each nation; values that look like slots are not read again."""
    own = table(spark, sf_dir, "nation")
    slots = F.create_map(F.lit("title"), F.col("n_name"), F.lit("var:key"), F.col("n_nationkey").cast("string"), F.lit("body"), F.concat(F.lit("{{quire:title}} of "), F.col("n_regionkey").cast("string")))
    return own.select("n_nationkey", T.fill(F.lit("<h1>{{quire:title}}</h1> {{quire:body}} {{quire:nothing}} {{ {{quire:var:key}}"), slots).alias("html"))


FILLED_SQL = "SELECT n_nationkey, '<h1>' || n_name || '</h1> {{quire:title}} of ' || n_regionkey || ' {{quire:nothing}} {{ ' || n_nationkey AS html FROM nation"


def slot_checks(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("{{quire:body}}{{quire:"), F.element_at(F.array(*[F.lit(x) for x in ("title", "bogus", "var:size", "var:other")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("}}")).alias("t"))
    declared = F.array(F.lit("size"))
    return own.select("p_partkey", F.array_join(T.unknown_slots(F.col("t"), declared), ",").alias("unknown"), F.array_join(T.unused_variables(F.col("t"), declared), ",").alias("unused"))


SLOTS_SQL = "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'bogus' WHEN 3 THEN 'var:other' ELSE '' END AS unknown, CASE p_partkey % 4 WHEN 2 THEN '' ELSE 'var:size' END AS unused FROM part"


def _packs(spark, sf_dir):
    """Suppliers as packs: an id that several share, a version, tags."""
    own = table(spark, sf_dir, "supplier")
    return own.select(
        F.concat(F.lit("org.nation"), F.col("s_nationkey").cast("string")).alias("id"), F.col("s_suppkey").alias("root"), F.col("s_name").alias("name"), F.col("s_name").alias("dir"), F.lit(None).cast("string").alias("description"),
        F.concat_ws(".", (F.col("s_suppkey") % 3).cast("string"), (F.col("s_suppkey") % 11).cast("string")).alias("version"), F.array(F.concat(F.lit("t"), (F.col("s_suppkey") % 5).cast("string")), F.lit("all")).alias("tags"),
        F.array(F.concat(F.lit("x"), (F.col("s_suppkey") % 13).cast("string")), F.lit("main")).alias("templates"),
    )


def discovered(spark, sf_dir):
    return catalog.first_wins(_packs(spark, sf_dir)).select("id", long(F.col("root")).alias("root"), "wins")


DISCOVERED_SQL = "SELECT 'org.nation' || s_nationkey AS id, s_suppkey AS root, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1 AS wins FROM supplier"


def resolved(spark, sf_dir):
    own = catalog.entries(catalog.first_wins(_packs(spark, sf_dir)).where("wins"))
    wanted = spark.range(13).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("ask")).unionByName(spark.sql("SELECT 'main' AS ask UNION ALL SELECT 'org.nation3:main' UNION ALL SELECT 'none'"))
    return catalog.resolve(own, wanted)


RESOLVED_SQL = r"""
WITH w AS (SELECT 'org.nation' || s_nationkey AS id, min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey), e AS (SELECT id, 'x' || (k % 13) AS t FROM w UNION ALL SELECT id, 'main' FROM w),
a AS (SELECT 'x' || range AS ask FROM range(13) UNION ALL SELECT unnest(['main', 'org.nation3:main', 'none'])),
k AS (SELECT id || ':' || t AS ask, 1 AS hits, id || ':' || t AS found FROM e UNION ALL SELECT t, count(*), min(id || ':' || t) FROM e GROUP BY t)
SELECT a.ask, coalesce(hits, 0) AS hits, CASE WHEN hits = 1 THEN found END AS found FROM a LEFT JOIN k ON a.ask = k.ask
"""


def searched(spark, sf_dir):
    return catalog.grid(_packs(spark, sf_dir), tag="t2", query="NATION1").select("id", "name", "version")


SEARCHED_SQL = "SELECT 'org.nation' || s_nationkey AS id, s_name AS name, (s_suppkey % 3) || '.' || (s_suppkey % 11) AS version FROM supplier WHERE s_suppkey % 5 = 2 AND (contains('org.nation' || s_nationkey, 'nation1') OR contains(lower(s_name), 'nation1'))"


def versions(spark, sf_dir):
    """Versions and ids of several shapes, good and bad ones."""
    own = _packs(spark, sf_dir)
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("root") % len(xs) + 1).cast("int"))
    whole = F.concat("version", pick(".0", "", ".01", ".2-rc.1", ".x", ".3+b"))
    name = F.concat(pick("", "O", "9", "-"), F.col("id"), pick("", ".", ".x-1", "..y", "_z"))
    return own.select("name", T.version_satisfies(F.col("version"), F.lit("1.5")).alias("new"), whole.alias("whole"), T.is_semver(whole).alias("semver"), name.alias("host"), T.is_reverse_dns(name).alias("dns"))


VERSIONS_SQL = r"""
SELECT s_name AS name, s_suppkey % 3 > 1 OR (s_suppkey % 3 = 1 AND s_suppkey % 11 >= 5) AS new,
  (s_suppkey % 3) || '.' || (s_suppkey % 11) || ['.0', '', '.01', '.2-rc.1', '.x', '.3+b'][s_suppkey % 6 + 1] AS whole, s_suppkey % 6 IN (0, 3, 5) AS semver,
  ['', 'O', '9', '-'][s_suppkey % 4 + 1] || 'org.nation' || s_nationkey || ['', '.', '.x-1', '..y', '_z'][s_suppkey % 5 + 1] AS host, s_suppkey % 4 = 0 AND s_suppkey % 5 IN (0, 2) AS dns FROM supplier
"""


def hashes(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").cast("binary").alias("content"))
    listed = table(spark, sf_dir, "part").where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 1, F.sha2("p_name", 256)).otherwise("0").alias("sha256"))
    return catalog.verified(own, listed)


HASHES_SQL = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS ok FROM part"


def tags(spark, sf_dir):
    return catalog.all_tags(_packs(spark, sf_dir))


TAGS_SQL = "SELECT DISTINCT unnest(['t' || (s_suppkey % 5), 'all']) AS tag FROM supplier"


def latest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return convert.latest(events, "user_id", "event_id").select("user_id", "event_id", "event_type")


LATEST_SQL = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"


def recent(spark, sf_dir):
    """The ten users seen last."""
    return convert.recent(table(spark, sf_dir, "events"), "user_id", "event_id")


RECENT_SQL = "SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id ORDER BY last DESC LIMIT 10"


def changes(spark, sf_dir):
    """Each event beside the one before of its user."""
    return convert.with_previous(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type").select("event_id", "event_type", F.col("before_event_type").alias("before"))


CHANGES_SQL = "SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events"


def result_tables(spark, sf_dir):
    """Nations of a region as a query result, as a framed table or as plain rows: which kinds of table the rows make."""
    own = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("all"))
    plain = F.transform("all", lambda x: F.concat(F.lit(" "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit("\n")))
    framed = F.transform("all", lambda x: F.concat(F.lit("| "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |\n")))
    rule = F.lit("+-----+------+\n")
    result = F.concat(F.array(F.lit("Nations\n"), F.lit(" key | name\n"), F.lit("-----+------\n")), plain, F.array(F.concat(F.lit("("), F.col("n").cast("string"), F.lit(" rows)\n"))))
    border = F.concat(F.array(rule, F.lit("| key | name |\n"), rule), framed, F.array(rule))
    rows = F.when(F.col("doc_id") % 3 == 0, result).when(F.col("doc_id") % 3 == 1, border).otherwise(plain)
    own = own.select("doc_id", rows.alias("rows"))
    html = convert.to_html(own.select("doc_id", F.array_join("rows", "").alias("text")), ConvertOptions(extract=True, make_tables=True, make_links=False, table_type=TableTypes(align=False))).select(F.col("doc_id").alias("d"), "html")
    own = own.join(html, F.col("doc_id") == F.col("d"))
    n_heads = (F.length("html") - F.length(F.replace("html", F.lit("<th>"), F.lit("")))) / 4
    return own.select(long(F.col("doc_id")).alias("doc_id"), predicates.is_pgsql_table(F.col("rows")).alias("pgsql"), predicates.is_border_table(F.col("rows")).alias("border"), F.coalesce(predicates.table_kind(F.col("rows"), F.lit(False)), F.lit("")).alias("kind"), F.contains("html", F.lit("<table")).alias("is_table"), long(n_heads).alias("n_heads"))


RESULT_TABLES_SQL = """
SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS doc_id, n_regionkey % 3 = 0 AS pgsql, n_regionkey % 3 = 1 AS border, ['PGSQL', 'BORDER', ''][n_regionkey % 3 + 1] AS kind, n_regionkey % 3 < 2 AS is_table,
  CAST(CASE WHEN n_regionkey % 3 < 2 THEN 2 ELSE 0 END AS BIGINT) AS n_heads FROM nation
"""


def alignment(spark, sf_dir):
    """Columns of padded cells as tables in plain text: how the converted tables say that they lean."""
    cell = F.when(F.col("p_size") % 3 == 0, F.lpad(F.concat(F.lit("k"), F.col("p_size").cast("string")), 12, " ")).otherwise(F.rpad(F.concat(F.lit("k"), F.col("p_size").cast("string")), 12, " "))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 20).alias("doc_id"), "p_partkey", F.concat(cell, F.lit("  x\n")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "")
    texts = rows.groupBy("doc_id").agg(F.concat(F.lit("abcdefghijkl  x\n"), lines).alias("text"))
    done = convert.to_html(texts, ConvertOptions(extract=True, make_tables=True, make_links=False))
    return done.select(long(F.col("doc_id")).alias("col"), F.regexp_extract("html", '<td(?: class="align-([a-z]+)")?>', 1).alias("align"), long((F.length("html") - F.length(F.replace("html", F.lit("<tr>"), F.lit("")))) / 4).alias("n_rows"))


ALIGNMENT_SQL = r"""
SELECT CAST(p_partkey % 20 AS BIGINT) AS col, CASE WHEN 2 * count(*) FILTER (p_size % 3 = 0) > count(*) THEN 'right' ELSE '' END AS align, count(*) + 1 AS n_rows FROM part GROUP BY ALL
"""


def converted(spark, sf_dir):
    """Every document as a whole HTML document; counts of what was found."""
    from quire.functions import html as H

    done = convert.to_html(table(spark, sf_dir, "documents"), ConvertOptions(title="Document"))
    return done.select("doc_id", "error", F.md5(F.col("html").cast("binary")).alias("md5"), *[c.alias(n) for n, c in H.counts(F.col("html")).items()])


def chunked(spark, sf_dir):
    return convert.chunked_pages(table(spark, sf_dir, "documents"), ConvertOptions(chunk_chars=2000, outfile="x.html")).select("doc_id", long(F.col("page_no")).alias("page_no"), "name", F.md5(F.col("html").cast("binary")).alias("md5"))


def char_chunks(spark, sf_dir):
    return records.char_chunks(table(spark, sf_dir, "documents"), 1000).select("doc_id", long(F.col("chunk_no")).alias("chunk_no"), long(F.length("chunk")).alias("n_chars"))


CHAR_CHUNKS_SQL = r"""
WITH RECURSIVE c AS (
  SELECT doc_id, 0 AS chunk_no, CAST('' AS VARCHAR) AS chunk, text AS rest FROM documents
  UNION ALL
  SELECT doc_id, chunk_no + 1, substr(rest, 1, cut), regexp_replace(substr(rest, cut + 1), '^[^\S\n]+', '') FROM (
    SELECT *, CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN stop > 0 THEN 800 + stop WHEN comma > 0 THEN 800 + comma WHEN blank > 0 THEN 800 + blank ELSE 1000 END AS cut FROM (
      SELECT *, length(regexp_extract(w, '(?s)^.*[.!?;:。！？；：．]')) AS stop, length(regexp_extract(w, '(?s)^.*[,、，]')) AS comma, length(regexp_extract(w, '(?s)^.*\s')) AS blank
      FROM (SELECT *, substr(rest, 801, 200) AS w FROM c WHERE rest <> '')))
)
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, length(chunk) AS n_chars FROM c WHERE chunk_no > 0
"""


def streamed(spark, sf_dir):
    """The documents brought paragraph by paragraph through the streaming form, until nothing is left to read."""
    from quire.streaming import documents as S

    base = f"{shared_dir(spark)}/quire/stream-{uuid.uuid4().hex}"
    S.paragraphs(table(spark, sf_dir, "documents")).write.parquet(f"{base}/in")
    done = S.to_html(S.read_stream(spark, f"{base}/in"), ConvertOptions(make_links=False)).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(S.OUT).parquet(f"{base}/out").select("doc_id", long(F.col("para_no")).alias("para_no"), F.md5(F.col("html").cast("binary")).alias("md5"))


QUERIES = {
    "q14_titles_and_levels": (titles, TITLES_SQL),
    "q16_heading_numbers": (heading_numbers, NUMBERS_SQL),
    "q17_sections": (section_rows, SECTION_ROWS_SQL),
    "q18_contents": (contents, CONTENTS_SQL),
    "q19_pages": (pages, PAGES_SQL),
    "q20_page_contents": (page_contents, PAGE_CONTENTS_SQL),
    "q22_sectioned": (sectioned, SECTIONED_SQL),
    "q30_result_tables": (result_tables, RESULT_TABLES_SQL),
    "q31_alignment": (alignment, ALIGNMENT_SQL),
    "q33_template_fill": (filled, FILLED_SQL),
    "q34_slot_checks": (slot_checks, SLOTS_SQL),
    "q35_note_numbers": (note_numbers, NOTE_NUMBERS_SQL),
    "q36_note_problems": (note_problems, NOTE_PROBLEMS_SQL),
    "q37_packs_discovered": (discovered, DISCOVERED_SQL),
    "q37_packs_resolved": (resolved, RESOLVED_SQL),
    "q38_catalog_search": (searched, SEARCHED_SQL),
    "q38_catalog_tags": (tags, TAGS_SQL),
    "q39_versions": (versions, VERSIONS_SQL),
    "q40_pack_hashes": (hashes, HASHES_SQL),
    "q43_latest_job": (latest, LATEST_SQL),
    "q43_recent": (recent, RECENT_SQL),
    "q43_changes": (changes, CHANGES_SQL),
    "q44_convert": (converted, None),
    "q45_chunked_pages": (chunked, None),
    "q46_char_chunks": (char_chunks, CHAR_CHUNKS_SQL),
    "q47_streamed": (streamed, None),
}
