"""Classification metrics, threshold sweeps and ensembles (P6, P7, M13,
V1–V8, W4, W5).

Metrics are aggregates: one pass with conditional counts.  Rank metrics
(AUC, average precision) first aggregate to one row per distinct score, then
need running totals in score order; those are computed bucket-wise (approx
edges → per-bucket totals → offsets → window inside each bucket) so no
window ever spans the whole table.  Threshold sweeps bucket each score once
to the highest grid point it passes: O(rows + grid), never rows × grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions.buckets import bucketize
from attrition.functions.grid import grid_delta, grid_index_at_most, grid_size, safe_div
from attrition.session import cut_lineage


def _pos() -> Column:
    return F.col("__y") == 1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def threshold_predict(df: DataFrame, score: str, t: float = 0.5, out: str = "pred") -> DataFrame:
    """1 when score ≥ t."""
    return df.withColumn(out, (F.col(score) >= F.lit(t)).cast("int"))


def class_weights(df: DataFrame, label: str, weights: dict | str = "balanced") -> DataFrame:
    """Per-class weight table ``label, n, weight``; ``balanced`` gives
    n / (n_classes · n_class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if weights == "balanced":
        w = Window.partitionBy()  # over the per-class table (one row per class)
        return counts.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
    expr = F.lit(None).cast("double")
    for k, v in weights.items():
        expr = F.when(F.col(label) == F.lit(k), F.lit(float(v))).otherwise(expr)
    return counts.withColumn("weight", expr)


def with_weights(df: DataFrame, label: str, weights: dict | str = "balanced", out: str = "weight") -> DataFrame:
    """Adds a weight column.  The class table has one row per class;
    the planner broadcasts it where it is small."""
    tbl = class_weights(df, label, weights).select(F.col(label).alias("__lab"), F.col("weight").alias(out))
    return df.join(tbl, F.col(label) == F.col("__lab"), "left").drop("__lab")


def confusion(df: DataFrame, label: str, pred: str | Column, by: list[str] = ()) -> DataFrame:
    """V1: ``tn, fp, fn, tp`` (optionally per group)."""
    y, p = _c(label), _c(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def add_rates(cm: DataFrame) -> DataFrame:
    """V2, V3 from a confusion table (0 when a denominator is 0)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (cm.withColumn("accuracy", safe_div(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", safe_div(tp, tp + fp))
            .withColumn("recall", safe_div(tp, tp + fn))
            .withColumn("f1", safe_div(2 * tp, 2 * tp + fp + fn))
            .withColumn("specificity", safe_div(tn, tn + fp))
            .withColumn("fpr", safe_div(fp, fp + tn))
            .withColumn("fnr", safe_div(fn, fn + tp)))


def prf(df: DataFrame, label: str, pred: str | Column, by: list[str] = ()) -> DataFrame:
    return add_rates(confusion(df, label, pred, by))


def macro_f1(df: DataFrame, label: str, pred: str | Column, by: list[str] = ()) -> DataFrame:
    """Mean of the F1 of class 1 and class 0."""
    cm = confusion(df, label, pred, by)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cm.select(*by, ((safe_div(2 * tp, 2 * tp + fp + fn) + safe_div(2 * tn, 2 * tn + fn + fp)) / 2)
                     .alias("macro_f1"))


def weighted_objective(df: DataFrame, label: str, score: str, t: float = 0.4,
                       w_recall: float = 0.6, w_precision: float = 0.4) -> DataFrame:
    """V7: w_recall · recall + w_precision · precision at threshold t."""
    m = prf(df, label, (F.col(score) >= F.lit(t)).cast("int"))
    return m.select((F.lit(w_recall) * F.col("recall") + F.lit(w_precision) * F.col("precision"))
                    .alias("objective"), "recall", "precision")


# --- rank metrics -------------------------------------------------------------

def score_table(df: DataFrame, score: str | Column, label: str) -> DataFrame:
    """One row per distinct score: ``s, pos, neg`` (map-side combined)."""
    return (df.select(_c(score).cast("double").alias("s"), F.col(label).alias("__y"))
            .groupBy("s").agg(F.count_if(_pos()).alias("pos"), F.count_if(~_pos()).alias("neg")))


ROWS_PER_BUCKET = 1_000_000


def sums_above(tbl: DataFrame, order: str, cols: list[str], bins: int | None = None) -> DataFrame:
    """For each row, the sums of ``cols`` over rows with a strictly
    larger ``order`` value (``order`` distinct per row, neither null nor NaN).
    Bucket-wise: a window runs inside each bucket of about
    ``ROWS_PER_BUCKET`` rows and another over the bucket totals (one row per
    bucket, so a millionth of the table), which are joined back."""
    if bins is None:
        bins = max(256, math.ceil(tbl.count() / ROWS_PER_BUCKET))
    probs = [i / bins for i in range(1, bins)]
    edges = tbl.agg(F.percentile_approx(order, probs, 8 * bins)).first()[0] or []
    b = bucketize(tbl, order, edges, "__b")
    higher = Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tot = (b.groupBy("__b").agg(*[F.sum(c).alias(c) for c in cols])
           .select("__b", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"__{c}") for c in cols]))
    w = (Window.partitionBy("__b").orderBy(F.col(order).desc())
         .rowsBetween(Window.unboundedPreceding, -1))
    out = b.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_above") for c in cols]).join(tot, "__b")
    return out.select(*tbl.columns, *[(F.col(f"{c}_above") + F.col(f"__{c}")).alias(f"{c}_above") for c in cols])


def rank_metrics(df: DataFrame, score: str | Column, label: str) -> DataFrame:
    """V4, V5/W5 in one pass: ``auc``, ROC AUC as the rank statistic with tied
    scores counted half, and ``ap``, Σ ΔR · P over distinct scores from the top
    (step sum, not the trapezoid).  The scores are reduced to one row per
    distinct value and stored once.  Rows with a null or NaN score tie below all
    others; a metric without positives (or, for AUC, negatives) is null."""
    scores = cut_lineage(score_table(df, score, label))
    known = F.col("s").isNotNull() & ~F.isnan("s")
    t = scores.agg(*[F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).alias(a)
                     for n in ("pos", "neg") for c, a in ((known, n), (~known, f"last_{n}"))]).first()
    P, N = t["pos"] + t["last_pos"], t["neg"] + t["last_neg"]
    rows = sums_above(scores.where(known), "s", ["pos", "neg"]).select("pos", "neg", "pos_above", "neg_above")
    if t["last_pos"] + t["last_neg"]:
        rows = rows.unionByName(df.sparkSession.createDataFrame(
            [(t["last_pos"], t["last_neg"], t["pos"], t["neg"])], "pos bigint, neg bigint, pos_above bigint, neg_above bigint"))
    neg_below = F.lit(N) - F.col("neg_above") - F.col("neg")
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    auc_value = F.sum(F.col("pos") * (neg_below + 0.5 * F.col("neg"))) / F.lit(float(P) * float(N)) if P and N else F.lit(None)
    ap_value = F.sum((F.col("pos") / F.lit(float(P))) * (tp / (tp + fp))) if P else F.lit(None)
    return rows.agg(auc_value.cast("double").alias("auc"), ap_value.cast("double").alias("ap"))


def auc(df: DataFrame, score: str | Column, label: str) -> DataFrame:
    """V4 alone."""
    return rank_metrics(df, score, label).select("auc")


def average_precision(df: DataFrame, score: str | Column, label: str) -> DataFrame:
    """V5 alone."""
    return rank_metrics(df, score, label).select("ap")


# --- threshold sweeps ---------------------------------------------------------

def threshold_curve(df: DataFrame, score: str | Column, label: str, lo: float = 0.1,
                    hi: float = 0.9, step: float = 0.01, by: list[str] = ()) -> DataFrame:
    """V6 data: confusion counts and rates at every grid threshold
    ``lo + i·delta`` (prediction = score ≥ threshold), optionally per group.

    Each row is bucketed once; counts per (group, bucket) are reverse-summed
    over ≤ grid+1 rows per group."""
    n = grid_size(lo, hi, step)
    base = df.select(*by, _c(score).cast("double").alias("__s"), F.col(label).alias("__y"))
    per = (base.groupBy(*by, grid_index_at_most(F.col("__s"), lo, step, n).alias("i"))
           .agg(F.count_if(_pos()).alias("pos"), F.count_if(~_pos()).alias("neg")))
    # class totals from the (small) per-bucket table: no second scan of the rows
    tot = per.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = tot.select(*by, "P", "N", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    j = grid.join(per, [*by, "i"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = grid_delta(lo, step)
    curve = (j.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
             .withColumn("fn", F.col("P") - F.col("tp")).withColumn("tn", F.col("N") - F.col("fp"))
             .withColumn("threshold", F.lit(lo) + F.col("i") * F.lit(d))
             .drop("pos", "neg", "P", "N"))
    return add_rates(curve).drop("specificity", "fpr", "fnr")


def best_threshold(curve: DataFrame, metric: str, min_precision: float | None = None,
                   min_recall: float | None = None, default_t: float = 0.5,
                   by: list[str] = (), order: list[str] = ("i",)) -> DataFrame:
    """V6 choice: the largest ``metric`` among thresholds meeting the
    constraints, first in grid order on ties; a strictly positive value is
    needed, else (default_t, 0)."""
    ok = F.col(metric) > 0
    if min_precision is not None:
        ok = ok & (F.col("precision") >= min_precision)
    if min_recall is not None:
        ok = ok & (F.col("recall") >= min_recall)
    cand = curve.where(ok).select(*by, *order, "threshold", F.col(metric).alias("value"),
                                  F.lit(0).alias("__prio"))
    dflt = (curve.select(*by).distinct()
            .select(*by, *[F.lit(None).cast("int").alias(o) for o in order],
                    F.lit(default_t).alias("threshold"), F.lit(0.0).alias("value"), F.lit(1).alias("__prio")))
    allc = cand.unionByName(dflt)
    w = Window.partitionBy(*by).orderBy("__prio", F.col("value").desc(), *[F.col(o).asc() for o in order])
    return (allc.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1)
            .drop("__rn", "__prio", *order))


def ensemble_prob(p1: Column, p2: Column, w1: Column, w2: Column) -> Column:
    """(p1·w1 + p2·w2) / (w1 + w2)."""
    return (p1 * w1 + p2 * w2) / (w1 + w2)


def ensemble_grid(df: DataFrame, s1: str, s2: str, label: str,
                  w_lo: float = 0.1, w_hi: float = 1.0, w_step: float = 0.1,
                  t_lo: float = 0.3, t_hi: float = 0.7, t_step: float = 0.01) -> DataFrame:
    """V8: curve over weights × thresholds; rows × weights (small, narrow),
    then the bucketed sweep per weight.  Output has ``w_i, w1, w2, i, …``."""
    nw = grid_size(w_lo, w_hi, w_step)
    dw = grid_delta(w_lo, w_step)
    rows = df.select(F.col(s1).cast("double").alias("__p1"), F.col(s2).cast("double").alias("__p2"),
                     F.col(label).alias("__lab"),
                     F.explode(F.sequence(F.lit(0), F.lit(nw - 1))).alias("w_i"))
    w1 = F.lit(w_lo) + F.col("w_i") * F.lit(dw)
    rows = rows.withColumn("w1", w1).withColumn("w2", F.lit(1.0) - F.col("w1"))
    rows = rows.withColumn("__p", ensemble_prob(F.col("__p1"), F.col("__p2"), F.col("w1"), F.col("w2")))
    return threshold_curve(rows, "__p", "__lab", t_lo, t_hi, t_step, by=["w_i", "w1", "w2"])


def best_ensemble(grid: DataFrame, min_recall: float = 0.8, min_precision: float = 0.5) -> DataFrame:
    """V8 choice: best F1 under both constraints, first in loop order
    (weight, then threshold); default weights (0.5, 0.5) and t = 0.5."""
    ok = (F.col("f1") > 0) & (F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)
    cand = grid.where(ok).select("w_i", "i", "w1", "w2", "threshold", F.col("f1").alias("value"),
                                 F.lit(0).alias("__prio"))
    dflt = grid.agg(F.lit(None).cast("int").alias("w_i")).select(
        "w_i", F.lit(None).cast("int").alias("i"), F.lit(0.5).alias("w1"), F.lit(0.5).alias("w2"),
        F.lit(0.5).alias("threshold"), F.lit(0.0).alias("value"), F.lit(1).alias("__prio"))
    w = Window.orderBy("__prio", F.col("value").desc(), "w_i", "i")
    return (cand.unionByName(dflt).withColumn("__rn", F.row_number().over(w))
            .where(F.col("__rn") == 1).select("w1", "w2", "threshold", F.col("value").alias("f1")))


def ensemble_mean(a: DataFrame, b: DataFrame, key, w1: float, w2: float, t: float,
                  p: str = "p") -> DataFrame:
    """Join two score tables on the key, weighted mean, threshold."""
    keys = [key] if isinstance(key, str) else list(key)
    j = a.select(*keys, F.col(p).alias("__p1")).join(b.select(*keys, F.col(p).alias("__p2")), keys)
    pe = ensemble_prob(F.col("__p1"), F.col("__p2"), F.lit(w1), F.lit(w2))
    return j.select(*keys, pe.alias("p"), (pe >= F.lit(t)).cast("int").alias("pred"))
