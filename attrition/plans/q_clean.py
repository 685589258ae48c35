"""Scan, projection and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.functions.hashing import duckdb_uniform, hash_uniform
from attrition.operators import clean
from attrition.plans.registry import query
from attrition.session import scratch_table_path
from attrition.sources.tables import paired_scan, read_csv, read_table, write_report
from attrition.sources.views import (CHURN_SQL, LINE_KEY, LINE_KEY_SQL, LINE_SQL, NULL_SQL,
                                     churn_view, line_view, null_view, with_views)

NULL_COLS = [("doc_id", "bigint"), ("lang", "string"), ("source", "string"),
             ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]


def _profile_sql() -> str:
    counts = ", ".join(f"count({c}) AS a{i}" for i, (c, _) in enumerate(NULL_COLS))
    parts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, a{i} AS non_null, n_rows, "
        f"{len(NULL_COLS)} AS n_cols FROM c" for i, (c, t) in enumerate(NULL_COLS))
    return with_views(f"c AS (SELECT count(*) AS n_rows, {counts} FROM nv)\n{parts}", NULL_SQL)


@query("table_profile", _profile_sql(), ops="S3")
def table_profile(spark, sf_dir):
    return clean.table_profile(null_view(spark, sf_dir))


@query("null_counts", with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM nv"
    for c, _ in NULL_COLS), NULL_SQL), ops="C1")
def null_counts(spark, sf_dir):
    return clean.null_counts(null_view(spark, sf_dir))


@query("dropna_any", with_views(
    "SELECT * FROM nv WHERE " + " AND ".join(f"{c} IS NOT NULL" for c, _ in NULL_COLS), NULL_SQL),
    ops="C2")
def dropna_any(spark, sf_dir):
    return clean.dropna_any(null_view(spark, sf_dir))


@query("null_map", with_views("""
r AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM nv),
f AS (SELECT CAST(floor((doc_id - lo) * 20 / (hi - lo + 1)) AS INTEGER) AS bucket,
             CAST(lang IS NULL AS INTEGER) AS lang, CAST(source IS NULL AS INTEGER) AS source,
             CAST(n_chars IS NULL AS INTEGER) AS n_chars, CAST(quality IS NULL AS INTEGER) AS quality,
             CAST(toxic IS NULL AS INTEGER) AS toxic
      FROM nv, r),
u AS (UNPIVOT f ON lang, source, n_chars, quality, toxic INTO NAME "column" VALUE is_null)
SELECT bucket, "column", round(avg(is_null), 6) AS null_rate, count(*) AS n FROM u GROUP BY bucket, "column" """,
    NULL_SQL), ops="C5")
def null_map(spark, sf_dir):
    return clean.null_map(null_view(spark, sf_dir), "doc_id", 20)


@query("dup_rows", """
SELECT doc_id, lang, source, n_chars FROM (
  SELECT doc_id, lang, source, n_chars, min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM documents) WHERE doc_id <> first_id""", ops="C3 W1")
def dup_rows(spark, sf_dir):
    # whole texts are hashed where they are read; only 32-byte digests are shuffled
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("text_sha"), "lang", "source", "n_chars")
    return clean.duplicate_rows(docs, ["text_sha"], "doc_id").drop("text_sha")


@query("dup_flags", with_views(f"""
SELECT {LINE_KEY_SQL}, l_quantity, l_discount, l_tax,
       CAST(row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax
                               ORDER BY {LINE_KEY_SQL}) > 1 AS INTEGER) AS is_dup
FROM line""", LINE_SQL), ops="W1")
def dup_flags(spark, sf_dir):
    li = line_view(spark, sf_dir).select(*LINE_KEY, "l_quantity", "l_discount", "l_tax")
    return clean.duplicate_flags(li, ["l_quantity", "l_discount", "l_tax"], list(LINE_KEY))


@query("dedup_keep_first", with_views(f"""
SELECT {LINE_KEY_SQL}, l_quantity, l_discount, l_tax FROM (
  SELECT *, row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax
                               ORDER BY {LINE_KEY_SQL}) AS rn FROM line) WHERE rn = 1""",
    LINE_SQL), ops="C4")
def dedup_keep_first(spark, sf_dir):
    li = line_view(spark, sf_dir).select(*LINE_KEY, "l_quantity", "l_discount", "l_tax")
    return clean.dedup_keep_first(li, ["l_quantity", "l_discount", "l_tax"], list(LINE_KEY))


@query("dedup_text", """
SELECT text_min_id AS doc_id, n_copies FROM (
  SELECT min(doc_id) AS text_min_id, count(*) AS n_copies FROM documents GROUP BY text)""",
    ops="C4")
def dedup_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return (docs.groupBy(F.sha2("text", 256).alias("text_sha"))
            .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))
            .drop("text_sha"))


@query("preview", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 5",
       ops="S4 O3")
def preview(spark, sf_dir):
    return clean.preview(read_table(spark, sf_dir, "customer"), ["c_name", "c_acctbal"], "c_custkey")


@query("drop_cols", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_shipdate FROM lineitem""", ops="P1")
def drop_cols(spark, sf_dir):
    return clean.drop_cols(read_table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("select_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer", ops="P2 P3")
def select_numeric(spark, sf_dir):
    return clean.select_numeric(read_table(spark, sf_dir, "customer"))


@query("bool_to_int", """
SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS pos_balance,
       CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS is_building FROM customer""", ops="P4")
def bool_to_int(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return clean.bool_to_int(c.select("c_custkey", (F.col("c_acctbal") > 0).alias("pos_balance"),
                                      (F.col("c_mktsegment") == "BUILDING").alias("is_building")))


@query("class_filter", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_returnflag = 'R'""", ops="P5")
def class_filter(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return (clean.class_filter(li, "l_returnflag", "R")
            .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@query("zip_columns", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", ops="J1")
def zip_columns(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return clean.zip_columns(c.select("c_custkey", "c_name"),
                             c.select("c_custkey", "c_acctbal", "c_mktsegment"), "c_custkey")


@query("renumber", with_views("""
SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS row_no
FROM churn WHERE exited = 0""", CHURN_SQL), ops="P8")
def renumber(spark, sf_dir):
    kept = churn_view(spark, sf_dir).where(F.col("exited") == 0).select("c_custkey")
    return clean.renumber(kept, "c_custkey")


@query("paired_scan", with_views(f"""
SELECT c_custkey, c_name, r_name, c_mktsegment, c_acctbal, n_orders, spend, n_prio FROM churn
WHERE {duckdb_uniform(42, 'c_custkey')} >= 0.7""", CHURN_SQL), ops="S2")
def paired(spark, sf_dir):
    ch = churn_view(spark, sf_dir)
    u = hash_uniform(42, "c_custkey")
    train = ch.where(u < 0.7)
    score = ch.where(u >= 0.7).drop("exited")
    _, scored = paired_scan(train, score, "exited")
    return scored


CSV_TYPES = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int"


@query("csv_scan", "SELECT p_partkey AS row_id, p_name, p_brand, p_type, p_size FROM part", ops="S1 S5")
def csv_scan(spark, sf_dir):
    """The part table, written as CSV and scanned back with a schema and a renamed key."""
    part = read_table(spark, sf_dir, "part")
    cols = [c.split()[0] for c in CSV_TYPES.split(", ")]
    path = scratch_table_path(spark, "csv")
    part.select(*cols).write.option("header", True).csv(path)
    return read_csv(spark, path, CSV_TYPES, key="row_id")


@query("csv_scan_inferred", """
SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 0.5 ELSE o_orderkey END::DOUBLE AS v, count(*) AS n FROM orders GROUP BY 1""", ops="S1")
def csv_scan_inferred(spark, sf_dir):
    """Types inferred from all rows: a fraction in every fiftieth row makes the column a double."""
    path = scratch_table_path(spark, "csv")
    v = F.expr("CASE WHEN o_orderkey % 50 = 0 THEN concat(o_orderkey, '.5') ELSE cast(o_orderkey AS string) END")
    read_table(spark, sf_dir, "orders").select(v.alias("v")).write.option("header", True).csv(path)
    return read_csv(spark, path).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


@query("report_roundtrip", with_views("SELECT c_mktsegment, exited, count(*) AS n FROM churn GROUP BY ALL", CHURN_SQL), ops="S5")
def report_roundtrip(spark, sf_dir):
    path = scratch_table_path(spark, "report")
    write_report(churn_view(spark, sf_dir).groupBy("c_mktsegment", "exited").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.parquet(path)
