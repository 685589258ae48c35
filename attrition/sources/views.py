"""Derived views over the driver tables that stand in for the churn CSV.

Each view is a Spark DataFrame builder plus the same definition as DuckDB
SQL (used only by the correctness oracle).

* churn view  – one row per customer; ``cut`` = latest order date − 365
  days; features use orders up to ``cut`` only, ``exited`` = no order after.
* line view   – ``lineitem`` with a unique composite key and a 0/1 label.
* doc view    – ``documents`` ⋈ ``labels`` with text features.
* null view   – ``documents`` left join ``labels`` (unlabelled → nulls).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.roles import Roles
from attrition.sources.tables import read_table

CHURN_ROLES = Roles(
    key="c_custkey", label="exited",
    numeric=("c_acctbal", "n_orders", "spend", "n_prio"),
    nominal=("r_name", "c_mktsegment"),
    ignore=("c_name",),
)

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_cents")
LINE_ROLES = Roles(
    key=LINE_KEY, label="label",
    numeric=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    binary=("l_linestatus",),
)

DOC_ROLES = Roles(
    key="doc_id", label="quality",
    numeric=("log_len", "non_letter_share", "n_words", "digit_share", "distinct_ratio"),
    nominal=("lang",),
)


def churn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    # scalar subquery: evaluated once, no join needed to use it per row
    cut = orders.select(F.max("o_orderdate")).scalar() - F.expr("INTERVAL 365 DAYS")
    before = F.col("o_orderdate") <= cut
    per_cust = (orders
                .groupBy("o_custkey")
                .agg(F.count_if(before).alias("n_before"),
                     F.sum(F.when(before, F.col("o_totalprice"))).alias("spend"),
                     F.count_distinct(F.when(before, F.col("o_orderpriority"))).alias("n_prio_all"),
                     F.count_if(~before).alias("n_after")))
    cust = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    has_before = F.col("n_before") > 0
    return (cust
            .join(nation, cust.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .join(per_cust, cust.c_custkey == per_cust.o_custkey, "left")
            .select("c_custkey", "c_name", "r_name", "c_mktsegment", "c_acctbal",
                    F.when(has_before, F.col("n_before")).alias("n_orders"),
                    "spend",
                    F.when(has_before, F.col("n_prio_all")).alias("n_prio"),
                    F.when(F.coalesce(F.col("n_after"), F.lit(0)) == 0, 1).otherwise(0)
                     .cast("int").alias("exited")))


CHURN_SQL = """
churn AS (
  SELECT c.c_custkey, c.c_name, r.r_name, c.c_mktsegment, c.c_acctbal,
         CASE WHEN a.n_before > 0 THEN a.n_before END AS n_orders,
         a.spend,
         CASE WHEN a.n_before > 0 THEN a.n_prio_all END AS n_prio,
         CAST(CASE WHEN coalesce(a.n_after, 0) = 0 THEN 1 ELSE 0 END AS INTEGER) AS exited
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (
    SELECT o_custkey,
           count(*) FILTER (WHERE o_orderdate <= k.cut) AS n_before,
           sum(CASE WHEN o_orderdate <= k.cut THEN o_totalprice END) AS spend,
           count(DISTINCT CASE WHEN o_orderdate <= k.cut THEN o_orderpriority END) AS n_prio_all,
           count(*) FILTER (WHERE o_orderdate > k.cut) AS n_after
    FROM orders, (SELECT max(o_orderdate) - INTERVAL '365' DAY AS cut FROM orders) k
    GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey
)"""


def line_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("l_cents"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_quantity") / 50.0).alias("s_qty"),
        (F.col("l_extendedprice") / 110000.0).alias("s_price"),
    )


LINE_SQL = """
line AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS l_cents,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         l_quantity / 50.0::DOUBLE AS s_qty,
         l_extendedprice / 110000.0::DOUBLE AS s_price
  FROM lineitem
)"""

LINE_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_cents"


def line_key_col():
    return F.concat_ws("|", *[F.col(c).cast("string") for c in LINE_KEY])


def _doc_features(docs: DataFrame) -> DataFrame:
    words = F.regexp_extract_all(F.col("text"), F.lit(r"\S+"), 0)
    n_chars = F.greatest(F.length("text"), F.lit(1))
    return docs.select(
        "doc_id", "lang", "source",
        F.log(F.col("n_chars") + 1).alias("log_len"),
        # a run at a time: the same text is left
        ((F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", ""))) / n_chars)
        .alias("letter_share"),
        ((F.length("text") - F.length(F.regexp_replace("text", r"[0-9]+", ""))) / n_chars)
        .alias("digit_share"),
        F.size(words).cast("bigint").alias("n_words"),
        (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)))
        .alias("distinct_ratio"),
    ).select("doc_id", "lang", "source", "log_len",
             (1 - F.col("letter_share")).alias("non_letter_share"),
             "n_words", "digit_share", "distinct_ratio")


def doc_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    return _doc_features(docs).join(labels, "doc_id")


DOC_SQL = r"""
doc AS (
  SELECT d.doc_id, d.lang, d.source,
         ln(d.n_chars + 1) AS log_len,
         1 - (length(d.text) - length(regexp_replace(d.text, '\p{L}', '', 'g')))
             / greatest(length(d.text), 1) AS non_letter_share,
         CAST(len(regexp_extract_all(d.text, '\S+')) AS BIGINT) AS n_words,
         (length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')))
             / greatest(length(d.text), 1) AS digit_share,
         len(list_distinct(regexp_extract_all(d.text, '\S+')))
             / greatest(len(regexp_extract_all(d.text, '\S+')), 1) AS distinct_ratio,
         l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def null_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")


NULL_SQL = """
nv AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the given view definitions as CTEs.

    ``sql`` is either a SELECT or further CTEs (``name AS (...), ... SELECT``)."""
    head = "WITH " + ",\n".join(v.strip() for v in views)
    body = sql.strip()
    if body[:6].upper() in ("SELECT", "(SELEC"):
        return head + "\n" + body
    return head + ",\n" + body
