"""One query for each operator, with production parameters, over whole tables; and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table

#: query -> (module, table)
OPERATORS = {
    "op1_html": ("op1_html", "pages"),
    "op2_suffix": ("op2_suffix", "documents"),
    "op3_pii": ("op3_pii", "documents"),
    "op4_langid": ("op4_langid", "documents"),
    "op5_packing": ("op5_packing", "documents"),
    "op6_jpeg": ("op6_jpeg", "documents"),
    "op7_jaccard": ("op7_jaccard", "documents"),
    "op8_toxicity": ("op8_toxicity", "documents"),
    "op9_quality": ("op9_quality", "documents"),
    "op10_mixing": ("op10_mixing", "documents"),
}


def _query(module: str, name: str) -> Callable[[SparkSession, str], DataFrame]:
    run = import_module(f"quire.llm.{module}").query
    if module == "op8_toxicity":
        return lambda spark, sf_dir: run(table(spark, sf_dir, name), table(spark, sf_dir, "labels"))
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(*v) for k, v in OPERATORS.items()}


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ticket
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rnk FROM sized GROUP BY source
), weighted AS (
  SELECT *, (rnk - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sources
), filled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER w AS caps, sum(weight) OVER () - sum(weight) OVER w AS later
  FROM weighted WINDOW w AS (ORDER BY cap / weight, rnk ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT *, caps * weight + cap * later <= total * weight AS is_full FROM filled
), rest AS (
  SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS left_over, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open_weight FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(left_over * weight AS DOUBLE) / open_weight END AS target, cap FROM rest
), quotas AS (
  SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), cap) AS quota FROM goals
), placed AS (
  SELECT s.*, q.source_size, q.target, q.quota,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ticket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""


OP2_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n_bytes FROM h),
w AS (SELECT doc_id, unnest(range(0, greatest(n_bytes - 99, 0))) AS p, x FROM n),
s AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS v FROM w),
c AS (SELECT doc_id, p, row_number() OVER (PARTITION BY v ORDER BY doc_id, p) > 1 AS again FROM s),
g AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, -1) AS new FROM c WHERE again),
i AS (SELECT doc_id, p, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM r),
k AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)) || CASE WHEN last THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM e JOIN n ON e.doc_id = n.doc_id GROUP BY e.doc_id)
SELECT n.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM n LEFT JOIN k ON n.doc_id = k.doc_id
"""

OP9_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM t),
v AS (SELECT doc_id, i, w || chr(10) || lead(w) OVER p || chr(10) || lead(w, 2) OVER p AS three FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) > 1 AS twice FROM v WHERE three IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE twice GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*+•‣◦▪·]')) AS n_bullets FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT t.doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '\p{L}')) AS letters
  FROM t LEFT JOIN l ON t.doc_id = l.doc_id LEFT JOIN r ON t.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 4 AND 2 * n_dup_lines > n_lines) OR 5 * letters < 2 * word_chars
    OR (3 * (length(text) - length(replace(text, '!', ''))) > n_words AND 10 * len(regexp_extract_all(text, '\p{Lu}')) > 9 * letters)
    OR (n_lines >= 10 AND 10 * n_bullets > 9 * n_lines)) AS kept
FROM f
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say; the other operators are tested against brute force, a round trip or held-out labels."""
    return {"op2_suffix": OP2_SQL, "op9_quality": OP9_SQL, "op10_mixing": OP10_SQL}
