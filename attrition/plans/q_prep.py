"""Encoding, scaling and split queries (E1–E6, D1–D3) on the churn view."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.functions.hashing import duckdb_uniform, hash_uniform
from attrition.operators import clean, encode, split
from attrition.plans.registry import query
from attrition.sources.views import CHURN_SQL, churn_view, with_views

U = duckdb_uniform(42, "c_custkey")
SCALE_COLS = ["c_acctbal", "spend", "n_orders", "n_prio"]
# fixed values: the five TPC-H regions and market segments (oracle side only)
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _train(spark, sf_dir):
    ch = churn_view(spark, sf_dir)
    return ch, ch.where(hash_uniform(42, "c_custkey") >= 0.3)


@query("label_encode", with_views("""
SELECT c_custkey,
       CAST(dense_rank() OVER (ORDER BY r_name) - 1 AS INTEGER) AS r_name_en,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment_en
FROM churn""", CHURN_SQL), ops="E1")
def label_encode(spark, sf_dir):
    ch = churn_view(spark, sf_dir)
    return encode.label_encode(ch, ["r_name", "c_mktsegment"]).select(
        "c_custkey", "r_name_en", "c_mktsegment_en")


@query("one_hot", with_views("SELECT c_custkey, " + ", ".join(
    f"CAST(r_name = '{v}' AS INTEGER) AS \"r_name_{v}\"" for v in REGIONS) + " FROM churn", CHURN_SQL),
    ops="E2")
def one_hot(spark, sf_dir):
    ch, train = _train(spark, sf_dir)
    return encode.fit_one_hot(train, "r_name").transform(ch.select("c_custkey", "r_name"))


@query("dummies", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INTEGER) AS c_mktsegment_{v}" for v in SEGMENTS) + " FROM customer",
    ops="E3 P4")
def dummies(spark, sf_dir):
    from attrition.sources.tables import read_table
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return clean.bool_to_int(encode.dummies(c, "c_mktsegment"))


def _scale_sql(kind: str) -> str:
    if kind == "minmax":
        stats = ", ".join(f"min({c}) AS o_{c}, max({c}) - min({c}) AS s_{c}" for c in SCALE_COLS)
    else:
        stats = ", ".join(f"avg({c}) AS o_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_COLS)
    cols = ", ".join(f"round(CASE WHEN s_{c} = 0 THEN 0.0 ELSE ({c} - o_{c}) / s_{c} END, 6) AS {c}"
                     for c in SCALE_COLS)
    return with_views(f"""
st AS (SELECT {stats} FROM churn WHERE {U} >= 0.3)
SELECT c_custkey, {cols} FROM churn, st""", CHURN_SQL)


@query("minmax_train_fit", _scale_sql("minmax"), ops="E5 E4")
def minmax_train_fit(spark, sf_dir):
    ch, train = _train(spark, sf_dir)
    return encode.fit_minmax(train, SCALE_COLS).transform(ch.select("c_custkey", *SCALE_COLS))


@query("standard_train_fit", _scale_sql("standard"), ops="E6 E4")
def standard_train_fit(spark, sf_dir):
    ch, train = _train(spark, sf_dir)
    return encode.fit_standard(train, SCALE_COLS).transform(ch.select("c_custkey", *SCALE_COLS))


@query("fit_apply_pair", with_views(f"""
st AS (SELECT min(c_acctbal) AS mn_a, max(c_acctbal) - min(c_acctbal) AS w_a,
              min(spend) AS mn_s, max(spend) - min(spend) AS w_s FROM churn WHERE {U} >= 0.3),
codes AS (SELECT c_mktsegment AS v, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code
          FROM (SELECT DISTINCT c_mktsegment FROM churn WHERE {U} >= 0.3))
SELECT c_custkey, codes.code AS c_mktsegment,
       round((c_acctbal - mn_a) / w_a, 6) AS c_acctbal, round((spend - mn_s) / w_s, 6) AS spend,
       {", ".join(f"CAST(r_name = '{v}' AS INTEGER) AS \"r_name_{v}\"" for v in REGIONS)}
FROM churn JOIN codes ON churn.c_mktsegment = codes.v, st WHERE {U} < 0.3""", CHURN_SQL), ops="E4 S2")
def fit_apply_pair(spark, sf_dir):
    ch, train = _train(spark, sf_dir)
    test = ch.where(hash_uniform(42, "c_custkey") < 0.3)
    prep = encode.fit_prep(train, label_cols=["c_mktsegment"], one_hot_cols=["r_name"],
                           scale_cols=["c_acctbal", "spend"])
    return prep.transform(test.select("c_custkey", "c_mktsegment", "r_name", "c_acctbal", "spend"))


@query("split_hash", with_views(f"""
SELECT c_custkey, CASE WHEN {U} < 0.3 THEN 'test' ELSE 'train' END AS split FROM churn""",
                                CHURN_SQL), ops="D1")
def split_hash(spark, sf_dir):
    return split.split_hash(churn_view(spark, sf_dir).select("c_custkey"), "c_custkey", 0.3)


@query("split_exact", with_views(f"""
SELECT c_custkey, exited,
       CASE WHEN row_number() OVER (PARTITION BY exited ORDER BY {U}, c_custkey) - 1
                 < ceil(0.3 * count(*) OVER (PARTITION BY exited)) THEN 'test' ELSE 'train' END AS split
FROM churn""", CHURN_SQL), ops="D1")
def split_exact(spark, sf_dir):
    return split.split_exact(churn_view(spark, sf_dir).select("c_custkey", "exited"),
                             "c_custkey", "exited", 0.3)


SOME_LABELS = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE exited END"


@query("split_exact_null_label", with_views(f"""
SELECT c_custkey, exited,
       CASE WHEN row_number() OVER (PARTITION BY exited ORDER BY {U}, c_custkey) - 1
                 < ceil(0.3 * count(*) OVER (PARTITION BY exited)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT c_custkey, {SOME_LABELS} AS exited FROM churn)""", CHURN_SQL), ops="D1")
def split_exact_null_label(spark, sf_dir):
    """Null labels keep the quotas of the others exact and get one themselves."""
    some = churn_view(spark, sf_dir).select("c_custkey", F.expr(SOME_LABELS).alias("exited"))
    return split.split_exact(some, "c_custkey", "exited", 0.3)


U_SAMPLE = duckdb_uniform(42, "c_custkey", "'sample'")
U_FOLD = duckdb_uniform(42, "c_custkey", "'fold'")


@query("sample_n", with_views(f"""
SELECT c_custkey, exited FROM churn ORDER BY {U_SAMPLE}, c_custkey LIMIT 500""", CHURN_SQL), ops="D2")
def sample_n(spark, sf_dir):
    return split.sample_n(churn_view(spark, sf_dir).select("c_custkey", "exited"), "c_custkey", 500)


@query("kfold", with_views(f"""
SELECT c_custkey, CAST(floor({U_FOLD} * 5) AS INTEGER) AS fold FROM churn""", CHURN_SQL), ops="D3")
def kfold(spark, sf_dir):
    return split.kfold_hash(churn_view(spark, sf_dir).select("c_custkey"), "c_custkey", 5)


@query("kfold_exact", with_views(f"""
SELECT c_custkey, exited,
       CAST((row_number() OVER (PARTITION BY exited ORDER BY {U_FOLD}, c_custkey) - 1) % 5 AS INTEGER) AS fold
FROM churn""", CHURN_SQL), ops="D3")
def kfold_exact(spark, sf_dir):
    return split.kfold_exact(churn_view(spark, sf_dir).select("c_custkey", "exited"),
                             "c_custkey", "exited", 5)


@query("kfold_exact_null_label", with_views(f"""
SELECT c_custkey, exited,
       CAST((row_number() OVER (PARTITION BY exited ORDER BY {U_FOLD}, c_custkey) - 1) % 5 AS INTEGER) AS fold
FROM (SELECT c_custkey, {SOME_LABELS} AS exited FROM churn)""", CHURN_SQL), ops="D3")
def kfold_exact_null_label(spark, sf_dir):
    some = churn_view(spark, sf_dir).select("c_custkey", F.expr(SOME_LABELS).alias("exited"))
    return split.kfold_exact(some, "c_custkey", "exited", 5)


@query("split_class_counts", with_views(f"""
SELECT CASE WHEN {U} < 0.3 THEN 'test' ELSE 'train' END AS split, exited, count(*) AS n
FROM churn GROUP BY ALL""", CHURN_SQL), ops="D1 A6")
def split_class_counts(spark, sf_dir):
    s = split.split_hash(churn_view(spark, sf_dir), "c_custkey", 0.3)
    return s.groupBy("split", "exited").agg(F.count(F.lit(1)).alias("n"))
