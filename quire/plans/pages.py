"""Queries over web pages: counts, links and policy, outline, bodies, nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import html, urls
from quire.operators import nodes
from quire.plans.text import long, table

HOST = r"^[a-z]+://([^/?#]+)"
HREF = r"<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*\"([^\">]*)\""


def tag_counts(spark, sf_dir):
    counted = html.counts(F.col("html"))
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", HOST, 1).alias("host")).agg(long(F.count("*")).alias("n_pages"), *[long(F.sum(c)).alias(n) for n, c in counted.items()])


TAG_COUNTS_SQL = rf"""
SELECT regexp_extract(url, '{HOST}', 1) AS host, count(*) AS n_pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes,
  CAST(sum(len(regexp_extract_all(html, '(?i)<h[1-6]'))) AS BIGINT) AS headings, CAST(sum(len(regexp_extract_all(html, '(?i)<p[>\s]'))) AS BIGINT) AS paragraphs,
  CAST(sum(len(regexp_extract_all(html, '(?i)<strong'))) AS BIGINT) AS strong, CAST(sum(len(regexp_extract_all(html, '(?i)<br'))) AS BIGINT) AS br
FROM pages GROUP BY 1
"""


def report_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.report_line(html.counts(F.col("html"))).alias("report"))


REPORT_SQL = r"""
SELECT page_id, strlen(html) || ' bytes, ' || len(regexp_extract_all(html, '(?i)<h[1-6]')) || ' headings, ' || len(regexp_extract_all(html, '(?i)<p[>\s]')) || ' paragraphs, '
  || len(regexp_extract_all(html, '(?i)<strong')) || ' capitals, ' || len(regexp_extract_all(html, '(?i)<br')) || ' breaks' AS report FROM pages
"""


def hrefs(spark, sf_dir):
    """Each link of each page: scheme, whether the default and a strict policy let it stand, whether it leads outside."""
    own = table(spark, sf_dir, "pages").select("page_id", F.posexplode(urls.hrefs(F.concat("html", F.lit('<a href="'), "url", F.lit('">'), F.lit('<a href=" JavaScript:x()"><a href="mailto:a@b.c">')))).alias("pos", "href"))
    url = F.col("href")
    return own.select("page_id", long(F.col("pos")).alias("pos"), "href", urls.scheme_of(url).alias("scheme"), urls.allowed(url).alias("allowed"), urls.allowed(url, ("https", "mailto")).alias("strict"), urls.is_external(url).alias("external"))


HREFS_SQL = rf"""
WITH h AS (SELECT page_id, regexp_extract_all(html || '<a href="' || url || '">' || '<a href=" JavaScript:x()"><a href="mailto:a@b.c">', '{HREF.replace(chr(92) + '"', '"')}', 1) AS a FROM pages),
u AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS href FROM h),
s AS (SELECT *, nullif(lower(regexp_extract(regexp_replace(href, '^[\x00-\x20\x7f]+', ''), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)), '') AS scheme FROM u)
SELECT page_id, pos, href, scheme, scheme IS NULL OR scheme NOT IN ('javascript', 'data', 'vbscript', 'file') AS allowed,
  scheme IS NULL OR scheme IN ('https', 'mailto') AS strict, coalesce(scheme IN ('http', 'https', 'ftp', 'ftps'), false) AS external FROM s
"""


def links_by_host(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.regexp_extract("url", HOST, 1).alias("host"), F.explode(urls.hrefs(F.col("html"))).alias("href"))
    return own.groupBy("host").agg(long(F.count("*")).alias("n_links"), long(F.count_if(urls.is_external(F.col("href")))).alias("n_external"), long(F.countDistinct("href")).alias("n_distinct"))


LINKS_SQL = rf"""
WITH u AS (SELECT regexp_extract(url, '{HOST}', 1) AS host, unnest(regexp_extract_all(html, '{HREF.replace(chr(92) + '"', '"')}', 1)) AS href FROM pages)
SELECT host, count(*) AS n_links, count(*) FILTER (regexp_matches(href, '^(?i)(https?|ftps?):')) AS n_external, count(DISTINCT href) AS n_distinct FROM u GROUP BY host
"""


def outline(spark, sf_dir):
    """Headings of each page, and of three more that can be linked to: by id, by a name inside, by a link inside."""
    more = F.concat(F.lit('<h2 class="x" id="s'), F.col("page_id").cast("string"), F.lit('">One</h2><h3><a name="n1">Two</a></h3><H4><a href="#t">Three &amp;</a> x</H4>'))
    own = table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.outline(F.concat("html", more))).alias("ord", "h"))
    return own.select("page_id", long(F.col("ord")).alias("ord"), long(F.col("h.level")).alias("level"), html.anchor(F.col("h.attrs"), F.col("h.inner")).alias("anchor"), html.collapsed(html.decoded(html.without_tags(F.col("h.inner")))).alias("label"))


OUTLINE_SQL = r"""
WITH h AS (SELECT page_id, regexp_extract_all(html || '<h2 class="x" id="s' || page_id || '">One</h2><h3><a name="n1">Two</a></h3><H4><a href="#t">Three &amp;</a> x</H4>', '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>') AS a FROM pages), u AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS ord, unnest(a) AS h FROM h)
SELECT page_id, ord, CAST(substr(h, 3, 1) AS BIGINT) AS level, coalesce(nullif(regexp_extract(h, '(?i)^<h[1-6][^>]*\sid="([^"]*)"', 1), ''), nullif(regexp_extract(h, '(?i)\sname="([^"]*)"', 1), ''), regexp_extract(h, '(?i)\shref="#([^"]*)"', 1)) AS anchor,
  trim(regexp_replace(replace(replace(replace(replace(replace(trim(regexp_replace(h, '<[^>]*>', '', 'g'), ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS label FROM u
"""


def bodies(spark, sf_dir):
    own = html.body(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(own.cast("binary")).alias("body_md5"), long(F.length(html.collapsed(html.without_tags(own)))).alias("n_chars"))


BODIES_SQL = r"""
WITH b AS (SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body|\z)', 1) AS body FROM pages)
SELECT page_id, md5(body) AS body_md5, length(trim(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ')) AS n_chars FROM b
"""


def rel(spark, sf_dir):
    """Anchors of pages and of their own address, with rel where they lead outside."""
    own = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.concat(F.lit('<a href="'), "url", F.lit('">')), F.lit('<a href="/x">'), F.lit('<A rel="me" href="http://x.y/">'))).alias("a"))
    return own.select("page_id", urls.with_rel(F.col("a")).alias("a"))


REL_SQL = r"""
SELECT page_id, unnest([CASE WHEN regexp_matches(url, '^(https?|ftps?):') THEN '<a rel="nofollow noreferrer" href="' ELSE '<a href="' END || url || '">', '<a href="/x">', '<A rel="me" href="http://x.y/">']) AS a FROM pages
"""


def node_counts(spark, sf_dir):
    """Elements of each page by tag, from the parsed tree: how many there are, and with attributes."""
    return nodes.table(table(spark, sf_dir, "pages")).where("tag is not null").groupBy("page_id", "tag").agg(long(F.count("*")).alias("n"), long(F.count_if(F.size("attrs") > 0)).alias("with_attributes"))


BODY_SQL = r"SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*?)(?:</body|\z)', 1), '(?s)<!--.*?-->', '', 'g') AS b FROM pages"

NODES_SQL = rf"""
WITH b AS ({BODY_SQL}), t AS (SELECT page_id, unnest(regexp_extract_all(b, '<[a-zA-Z][^>]*>')) AS t FROM b)
SELECT page_id, lower(regexp_extract(t, '<([a-zA-Z][^\s/>]*)', 1)) AS tag, count(*) AS n, count(*) FILTER (regexp_matches(t, '<[a-zA-Z][^\s/>]*\s+[^\s/>]')) AS with_attributes FROM t GROUP BY ALL
"""


def page_text(spark, sf_dir):
    return nodes.text_of(nodes.table(table(spark, sf_dir, "pages")))


TEXT_SQL = rf"""
WITH b AS ({BODY_SQL}), t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '\s+', ' ', 'g'), '(?i)<br[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM b WHERE b <> ''),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM t)
SELECT page_id, trim(regexp_replace(t, ' *\n *', chr(10), 'g'), ' ') AS text FROM d
"""

QUERIES = {
    "q02_tag_counts": (tag_counts, TAG_COUNTS_SQL),
    "q11_report_lines": (report_lines, REPORT_SQL),
    "q24_hrefs": (hrefs, HREFS_SQL),
    "q25_links_by_host": (links_by_host, LINKS_SQL),
    "q41_outline": (outline, OUTLINE_SQL),
    "q42_page_text": (page_text, TEXT_SQL),
    "q51_bodies": (bodies, BODIES_SQL),
    "q52_link_rel": (rel, REL_SQL),
    "q53_node_counts": (node_counts, NODES_SQL),
}
