"""Metric, sweep and ensemble queries (P6, P7, V1–V8, M13, A16) on formula
scores over the line view (``s_qty`` = quantity/50 with many ties,
``s_price`` = price/110000 with almost none)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.grid import grid_sql
from attrition.functions.hashing import duckdb_uniform
from attrition.operators import metrics, split
from attrition.operators.profile import fold_summary
from attrition.plans.registry import query
from attrition.sources.views import LINE_KEY, LINE_KEY_SQL, LINE_SQL, line_view, with_views

SCORES = ["s_qty", "s_price"]


def _rates_sql() -> str:
    def sd(n, d):
        return f"round(CASE WHEN {d} = 0 THEN 0.0 ELSE ({n}) / ({d}) END, 6)"
    return ", ".join([
        f"{sd('tp + tn', 'tp + tn + fp + fn')} AS accuracy",
        f"{sd('tp', 'tp + fp')} AS precision", f"{sd('tp', 'tp + fn')} AS recall",
        f"{sd('2 * tp', '2 * tp + fp + fn')} AS f1"])


def _rates3_sql() -> str:
    def sd(n, d):
        return f"round(CASE WHEN {d} = 0 THEN 0.0 ELSE ({n}) / ({d}) END, 6)"
    return ", ".join([f"{sd('tn', 'tn + fp')} AS specificity", f"{sd('fp', 'fp + tn')} AS fpr",
                      f"{sd('fn', 'fn + tp')} AS fnr"])


def _cm_sql(pred: str) -> str:
    return (f"count(*) FILTER (WHERE label = 0 AND NOT ({pred})) AS tn, "
            f"count(*) FILTER (WHERE label = 0 AND ({pred})) AS fp, "
            f"count(*) FILTER (WHERE label = 1 AND NOT ({pred})) AS fn, "
            f"count(*) FILTER (WHERE label = 1 AND ({pred})) AS tp")


def _per_score(fn) -> DataFrame:
    return reduce(DataFrame.unionByName, [fn(s).withColumn("score", F.lit(s)) for s in SCORES])


@query("threshold_predict", with_views(f"""
SELECT {LINE_KEY_SQL}, CAST(s_price >= 0.56 AS INTEGER) AS pred FROM line""", LINE_SQL), ops="P6 F5")
def threshold_predict(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return metrics.threshold_predict(li, "s_price", 0.56).select(*LINE_KEY, "pred")


@query("class_weights", with_views("""
SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (2 * count(*)), 6) AS weight
FROM line GROUP BY label""", LINE_SQL), ops="P7")
def class_weights(spark, sf_dir):
    return metrics.class_weights(line_view(spark, sf_dir), "label")


@query("weighted_rows", with_views("""
SELECT label, count(*) AS n, round(sum(w), 6) AS total_weight FROM (
  SELECT label, CASE WHEN label = 1 THEN 0.68::DOUBLE ELSE 0.32::DOUBLE END AS w FROM line) GROUP BY label""",
    LINE_SQL), ops="P7")
def weighted_rows(spark, sf_dir):
    w = metrics.with_weights(line_view(spark, sf_dir), "label", {0: 0.32, 1: 0.68})
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total_weight"))


@query("confusion", with_views(" UNION ALL ".join(
    f"SELECT '{s}' AS score, {_cm_sql(f'{s} >= 0.5')} FROM line" for s in SCORES), LINE_SQL), ops="V1")
def confusion(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.confusion(li, "label", (F.col(s) >= 0.5).cast("int")))


@query("prf", with_views("SELECT score, tn, fp, fn, tp, " + _rates_sql() + " FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' AS score, {_cm_sql(f'{s} >= 0.5')} FROM line" for s in SCORES) + ")", LINE_SQL),
    ops="V2 F4")
def prf(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.prf(li, "label", (F.col(s) >= 0.5).cast("int"))
                      .select("tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1"))


@query("rates", with_views("SELECT score, " + _rates3_sql() + " FROM (" + " UNION ALL ".join(
    f"SELECT '{s}' AS score, {_cm_sql(f'{s} >= 0.5')} FROM line" for s in SCORES) + ")", LINE_SQL),
    ops="V3")
def rates(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.prf(li, "label", (F.col(s) >= 0.5).cast("int"))
                      .select("specificity", "fpr", "fnr"))


def _auc_sql(expr: str, name: str) -> str:
    return f"""SELECT '{name}' AS score, round(sum(pos * (coalesce(neg_below, 0) + 0.5 * neg))
                 / (sum(pos) * sum(neg)), 6) AS auc FROM (
  SELECT pos, neg, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below
  FROM (SELECT CAST({expr} AS DOUBLE) AS s, count(*) FILTER (WHERE label = 1) AS pos,
               count(*) FILTER (WHERE label = 0) AS neg FROM line GROUP BY 1))"""


def _ap_sql(expr: str, name: str) -> str:
    return f"""SELECT '{name}' AS score, round(sum(pos / P * tp / (tp + fp)), 6) AS ap FROM (
  SELECT pos, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
         sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp,
         sum(pos) OVER () AS P
  FROM (SELECT CAST({expr} AS DOUBLE) AS s, count(*) FILTER (WHERE label = 1) AS pos,
               count(*) FILTER (WHERE label = 0) AS neg FROM line GROUP BY 1))"""


@query("auc_prob", with_views(" UNION ALL ".join(_auc_sql(s, s) for s in SCORES), LINE_SQL), ops="V4 W4 W5")
def auc_prob(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.auc(li, s, "label"))


@query("auc_hard", with_views(" UNION ALL ".join(
    _auc_sql(f"CAST({s} >= 0.5 AS INTEGER)", s) for s in SCORES), LINE_SQL), ops="V4")
def auc_hard(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.auc(li, (F.col(s) >= 0.5).cast("int"), "label"))


MISSING = "CASE WHEN s_qty < 0.2 THEN NULL WHEN s_qty > 0.9 THEN CAST('NaN' AS DOUBLE) ELSE s_price END"


@query("rank_missing_scores", with_views(f"""
SELECT a.auc, p.ap FROM ({_auc_sql("coalesce(CASE WHEN isnan(x) THEN -1.0 ELSE x END, -1.0)", "x").replace("FROM line", "FROM miss")}) a,
({_ap_sql("coalesce(CASE WHEN isnan(x) THEN -1.0 ELSE x END, -1.0)", "x").replace("FROM line", "FROM miss")}) p""",
    LINE_SQL + f", miss AS (SELECT label, {MISSING} AS x FROM line)"), ops="V4 V5 W4 W5")
def rank_missing_scores(spark, sf_dir):
    """Null and NaN scores tie below all others."""
    x = line_view(spark, sf_dir).select("label", F.expr(MISSING).alias("x"))
    return metrics.rank_metrics(x, "x", "label")


@query("ap_prob", with_views(" UNION ALL ".join(_ap_sql(s, s) for s in SCORES), LINE_SQL), ops="V5 W4")
def ap_prob(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.average_precision(li, s, "label"))


@query("ap_hard", with_views(" UNION ALL ".join(
    _ap_sql(f"CAST({s} >= 0.5 AS INTEGER)", s) for s in SCORES), LINE_SQL), ops="V5")
def ap_hard(spark, sf_dir):
    li = line_view(spark, sf_dir)
    return _per_score(lambda s: metrics.average_precision(li, (F.col(s) >= 0.5).cast("int"), "label"))


def _curve_sql(score: str, lo: float, hi: float, step: float, src: str = "line",
               by: str = "") -> str:
    rng, pt = grid_sql(lo, hi, step, "g.i")
    by_sel = f"{by}, " if by else ""
    return f"""
g AS (SELECT CAST(range AS INTEGER) AS i FROM {rng}),
c AS (SELECT {by_sel}g.i, {pt} AS threshold,
             count(*) FILTER (WHERE label = 1 AND {score} >= {pt}) AS tp,
             count(*) FILTER (WHERE label = 0 AND {score} >= {pt}) AS fp,
             count(*) FILTER (WHERE label = 1 AND {score} < {pt}) AS fn,
             count(*) FILTER (WHERE label = 0 AND {score} < {pt}) AS tn
      FROM {src}, g GROUP BY ALL)"""


@query("sweep_curve", with_views(_curve_sql("s_qty", 0.1, 0.9, 0.01) + """
SELECT i, tp, fp, fn, tn, round(threshold, 6) AS threshold, """ + _rates_sql() + " FROM c", LINE_SQL),
    ops="V6 J4 F2")
def sweep_curve(spark, sf_dir):
    return metrics.threshold_curve(line_view(spark, sf_dir), "s_qty", "label", 0.1, 0.9, 0.01)


def _best_sql(metric: str, cond: str) -> str:
    return f"""
r AS (SELECT i, threshold, {_rates_sql()} FROM c),
b AS (SELECT threshold, {metric} AS value, 0 AS prio, i FROM r WHERE {metric} > 0 AND {cond}
      UNION ALL SELECT 0.5, 0.0, 1, NULL)
SELECT round(threshold, 6) AS threshold, value FROM b ORDER BY prio, value DESC, i LIMIT 1"""


@query("sweep_recall", with_views(_curve_sql("s_qty", 0.1, 0.9, 0.01) + ","
                                  + _best_sql("recall", "precision >= 0.335"), LINE_SQL), ops="V6 O2")
def sweep_recall(spark, sf_dir):
    curve = metrics.threshold_curve(line_view(spark, sf_dir), "s_qty", "label", 0.1, 0.9, 0.01)
    return metrics.best_threshold(curve, "recall", min_precision=0.335)


@query("sweep_f1", with_views(_curve_sql("s_price", 0.1, 0.9, 0.02) + ","
                              + _best_sql("f1", "recall >= 0.5 AND precision >= 0.33"), LINE_SQL),
       ops="V6 O2")
def sweep_f1(spark, sf_dir):
    curve = metrics.threshold_curve(line_view(spark, sf_dir), "s_price", "label", 0.1, 0.9, 0.02)
    return metrics.best_threshold(curve, "f1", min_precision=0.33, min_recall=0.5)


@query("weighted_objective", with_views(f"""
SELECT round(0.6 * recall + 0.4 * precision, 6) AS objective, recall, precision FROM (
  SELECT {_rates_sql()} FROM (SELECT {_cm_sql('s_price >= 0.4')} FROM line))""", LINE_SQL), ops="V7")
def weighted_objective(spark, sf_dir):
    return metrics.weighted_objective(line_view(spark, sf_dir), "label", "s_price", 0.4)


@query("macro_f1", with_views("""
SELECT round(((CASE WHEN 2*tp+fp+fn = 0 THEN 0.0 ELSE 2*tp/(2*tp+fp+fn) END)
            + (CASE WHEN 2*tn+fn+fp = 0 THEN 0.0 ELSE 2*tn/(2*tn+fn+fp) END)) / 2, 6) AS macro_f1
FROM (SELECT """ + _cm_sql("s_qty >= 0.5") + " FROM line)", LINE_SQL), ops="V9")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(line_view(spark, sf_dir), "label", (F.col("s_qty") >= 0.5).cast("int"))


@query("ensemble_mean", with_views(f"""
SELECT {LINE_KEY_SQL}, round((s_qty * 0.6 + s_price * 0.4) / (0.6 + 0.4), 6) AS p,
       CAST((s_qty * 0.6 + s_price * 0.4) / (0.6 + 0.4) >= 0.5 AS INTEGER) AS pred FROM line""",
    LINE_SQL), ops="M13 F3")
def ensemble_mean(spark, sf_dir):
    li = line_view(spark, sf_dir)
    a = li.select(*LINE_KEY, F.col("s_qty").alias("p"))
    b = li.select(*LINE_KEY, F.col("s_price").alias("p"))
    return metrics.ensemble_mean(a, b, list(LINE_KEY), 0.6, 0.4, 0.5)


def _ens_sql() -> str:
    wr, wp = grid_sql(0.1, 1.0, 0.1, "range")
    return f"""
w AS (SELECT CAST(range AS INTEGER) AS w_i, {wp} AS w1, 1.0::DOUBLE - {wp} AS w2 FROM {wr}),
e AS (SELECT w.w_i, w.w1, w.w2, label, (s_qty * w.w1 + s_price * w.w2) / (w.w1 + w.w2) AS p FROM line, w),
{_curve_sql("p", 0.3, 0.7, 0.01, "e", "w_i, w1, w2").strip()}"""


@query("ensemble_grid", with_views(_ens_sql() + """
SELECT w_i, round(w1, 6) AS w1, round(w2, 6) AS w2, i, tp, fp, fn, tn, round(threshold, 6) AS threshold, """
                                   + _rates_sql() + " FROM c", LINE_SQL), ops="V8 J4")
def ensemble_grid(spark, sf_dir):
    return metrics.ensemble_grid(line_view(spark, sf_dir), "s_qty", "s_price", "label")


@query("ensemble_best", with_views(_ens_sql() + """,
r AS (SELECT w_i, i, w1, w2, threshold, """ + _rates_sql() + """ FROM c),
b AS (SELECT w1, w2, threshold, f1 AS value, 0 AS prio, w_i, i FROM r
      WHERE f1 > 0 AND recall >= 0.8 AND precision >= 0.333
      UNION ALL SELECT 0.5, 0.5, 0.5, 0.0, 1, NULL, NULL)
SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(threshold, 6) AS threshold, value AS f1
FROM b ORDER BY prio, value DESC, w_i, i LIMIT 1""", LINE_SQL), ops="V8 O2")
def ensemble_best(spark, sf_dir):
    grid = metrics.ensemble_grid(line_view(spark, sf_dir), "s_qty", "s_price", "label")
    return metrics.best_ensemble(grid, min_recall=0.8, min_precision=0.333)


@query("fold_summary", with_views(f"""
SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std, count(*) AS n_folds,
       round(avg(acc) - 2 * stddev_pop(acc), 6) AS lo, round(avg(acc) + 2 * stddev_pop(acc), 6) AS hi
FROM (SELECT CAST(floor({duckdb_uniform(42, *LINE_KEY, "'fold'")} * 5) AS INTEGER) AS fold,
             avg(CAST((s_qty >= 0.5) = (label = 1) AS INTEGER)) AS acc FROM line GROUP BY 1)""",
    LINE_SQL), ops="A16 D3")
def fold_summary_q(spark, sf_dir):
    li = split.kfold_hash(line_view(spark, sf_dir), list(LINE_KEY), 5)
    per_fold = metrics.prf(li, "label", (F.col("s_qty") >= 0.5).cast("int"), by=["fold"])
    return fold_summary(per_fold.select("fold", F.col("accuracy").alias("acc")), [], "acc")
