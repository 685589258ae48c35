"""The query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import bin_packing, conversation_repair, decontam, html_layout, line_spread, lm_score, periodic_runs, quality_rules, secret_scan, simhash_dups, token_counts, url_filter, warc_index
from attrition.plans.registry import Query
from attrition.sources.tables import read_table as load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every document."""
    return quality_rules.quality_table(load(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, x)) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.n - lines.u, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(t) AS n_chars,
    len(regexp_extract_all(t, '!')) AS n_ex, len(regexp_extract_all(t, '[A-Z]')) AS n_cap,
    len(regexp_extract_all(t, '[A-Za-z]')) AS n_let, len(regexp_extract_all(t, '[0-9]')) AS n_dig
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_ex > n_words)::BIGINT + 16 * (100 * n_cap > 50 * n_let)::BIGINT
    + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 64 * (100 * n_dig > 20 * n_chars)::BIGINT
    + 128 * (word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
  fail_bits & 31 = 0 AND bit_count(fail_bits & 224) < 2 AS kept, fail_bits FROM b
"""


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back through the index."""
    return warc_index.archive_table(load(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to FROM r
"""


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after boilerplate lines are gone, as counts and a digest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cleaned = line_spread.drop_boilerplate(docs, removed="n_removed")
    return cleaned.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars_left"),
                          F.md5("text").alias("text_md5"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
bad AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= 10),
k AS (
  SELECT l.*, bad.line IS NOT NULL AND NOT (bad.first_id = l.doc_id
    AND i = min(i) OVER (PARTITION BY l.doc_id, l.line)) AS gone
  FROM l LEFT JOIN bad USING (line)),
r AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM k GROUP BY doc_id)
SELECT doc_id, n_removed, length(t) AS n_chars_left, md5(t) AS text_md5 FROM r
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.count_table(load(spark, sf_dir, "documents"))


def op3_simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = load(spark, sf_dir, "documents")
    return simhash_dups.near_duplicates(docs).withColumnRenamed("key", "doc_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.secret_table(load(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return lm_score.lm_scores(load(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in the packed sequences."""
    return bin_packing.packed_table(load(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_layout.text_table(load(spark, sf_dir, "pages"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontam.contamination_table(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS x FROM (
    SELECT item, w, least(13, len(w)) AS size, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x FROM (
    SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= size)),
win AS (SELECT row_number() OVER (ORDER BY item, size, x) AS wid, item, size, string_split(x, ' ') AS w FROM bw),
term AS (SELECT wid, size, t, count(*) AS times FROM (SELECT wid, size, unnest(w) AS t FROM win) GROUP BY ALL),
terms AS (SELECT wid, count(*) AS n FROM term GROUP BY wid),
place AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
maybe AS (SELECT doc_id, wid FROM (SELECT DISTINCT doc_id, t FROM place) JOIN term USING (t) JOIN terms USING (wid) GROUP BY doc_id, wid, n HAVING count(*) = n),
occ AS (SELECT doc_id, wid, t, times, size, i FROM maybe JOIN term USING (wid) JOIN place USING (doc_id, t)),
full_stretch AS (SELECT doc_id, wid, a FROM (
    SELECT s.doc_id, s.wid, s.i AS a, o.t FROM occ s JOIN occ o ON s.doc_id = o.doc_id AND s.wid = o.wid AND o.i BETWEEN s.i AND s.i + s.size + 3
    GROUP BY s.doc_id, s.wid, s.i, o.t, o.times HAVING count(*) >= o.times)
  JOIN terms USING (wid) GROUP BY doc_id, wid, a, n HAVING count(*) = n),
near AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM full_stretch JOIN win USING (wid) GROUP BY doc_id),
m AS (SELECT doc_id, i, dw.size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.x = bw.x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)
"""

def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage and its cheapest repair."""
    return conversation_repair.repair_table(load(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words."""
    return periodic_runs.runs_table(load(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_filter.verdict_table(load(spark, sf_dir, "pages"))


QUERIES = [
    Query("op1_quality_rules", op1_quality_rules, OP1_SQL),
    Query("op2_token_counts", op2_token_counts, None),
    Query("op3_simhash_dups", op3_simhash_dups, None),
    Query("op4_warc_index", op4_warc_index, OP4_SQL),
    Query("op5_line_spread", op5_line_spread, OP5_SQL),
    Query("op6_secret_scan", op6_secret_scan, None),
    Query("op7_lm_score", op7_lm_score, None),
    Query("op8_bin_packing", op8_bin_packing, None),
    Query("op9_html_layout", op9_html_layout, None),
    Query("op10_decontam", op10_decontam, OP10_SQL),
    Query("op11_conversation_repair", op11_conversation_repair, None),
    Query("op12_periodic_runs", op12_periodic_runs, None),
    Query("op13_url_filter", op13_url_filter, None),
]
