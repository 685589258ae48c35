"""Cross-validated neighbour grid (T1, V9) and the winner's hold-out report.

All settings of the nearest-neighbour classifier – every k, both weightings – are
read from one ranked neighbour table per metric: the votes of the k nearest are
running sums over the rank.  The folds need no search of their own either.  One exact
neighbour join answers all runs (folds), each row from the rows of the other folds.

Labels are 0 and 1; a tied vote goes to 0, the lower label.  With ``distance``
weights, neighbours at distance 0 take all the weight.  Rows whose features hold a
null are an error of the caller.  A run with fewer than k training rows has no
cell for that k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions.grid import safe_div
from attrition.operators import neighbors
from attrition.session import cut_lineage

#: Vote sums that differ by less are tied.
TIE_DIGITS = 9


def ranked(query: DataFrame, ref: DataFrame, key: str, label: str, features: list[str], run: str, k_max: int, metric: str, others: bool = False) -> DataFrame:
    """(key, run, label, rank, dist, __nl): the ``k_max`` nearest reference rows of the
    query's own run (``others``: of all other runs), with their labels."""
    nn = neighbors.knn(query, ref, key, key, features, k_max, metric, **{"apart" if others else "within": [run]})
    labels = ref.select(F.col(key).alias("nkey"), F.col(label).alias("__nl")).distinct()
    own = query.select(key, run, label)
    return nn.join(labels, "nkey").join(own, key)


def votes(nn: DataFrame, key: str, run: str, label: str) -> DataFrame:
    """(key, run, label, k, weights, p, pred) for every k and weighting."""
    w = Window.partitionBy(run, key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.first("dist").over(w)
    weight = F.when(nearest == 0, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    sums = nn.select(key, run, label, F.col("rank").alias("k"),
                     F.sum(F.col("__nl").cast("double")).over(w).alias("u1"), F.col("rank").cast("double").alias("u"),
                     F.sum(weight * F.col("__nl")).over(w).alias("d1"), F.sum(weight).over(w).alias("d"))

    def side(name: str, ones: str, all_: str) -> Column:
        p = F.col(ones) / F.col(all_)
        return F.struct(F.lit(name).alias("weights"), p.alias("p"),
                        (F.round(p - F.lit(0.5), TIE_DIGITS) > 0).cast("int").alias("pred"))

    both = F.explode(F.array(side("uniform", "u1", "u"), side("distance", "d1", "d")))
    return sums.select(key, run, label, "k", both.alias("v")).select(key, run, label, "k", "v.weights", "v.p", "v.pred")


def cell_scores(voted: DataFrame, run: str, label: str, by: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 and macro F1 of each cell and run."""
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)

    y, hat = F.col(label) == 1, F.col("pred") == 1
    cm = voted.groupBy(*by, run).agg(n(y & hat, "tp"), n(~y & hat, "fp"), n(y & ~hat, "fn"), n(~y & ~hat, "tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = safe_div(2 * tp, 2 * tp + fp + fn), safe_div(2 * tn, 2 * tn + fn + fp)
    return cm.select(*by, run, ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), safe_div(tp, tp + fp).alias("precision"),
                     safe_div(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"))


def cv_grid(df: DataFrame, key: str, label: str, features: list[str], fold: str, folds: int, k_max: int,
            metrics: tuple[str, ...] = ("euclidean", "manhattan")) -> DataFrame:
    """One row per (metric, weights, k): mean and population std over the folds of
    accuracy and macro F1.  Two neighbour joins in all, whatever the number of cells."""
    rows = cut_lineage(df.select(key, label, fold, *features))
    out = None
    for metric in metrics:
        scores = cell_scores(votes(ranked(rows, rows, key, label, features, fold, k_max, metric, others=True), key, fold, label), fold, label, ["weights", "k"])
        part = scores.groupBy("weights", "k").agg(
            F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
            F.avg("macro_f1").alias("macro_f1_mean"), F.stddev_pop("macro_f1").alias("macro_f1_std"),
            F.count(F.lit(1)).alias("n_folds")).select(F.lit(metric).alias("metric"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def best_cell(grid: DataFrame, objective: str) -> dict:
    """The cell of the highest objective; ties: the metric's and the weighting's name
    in alphabetical order, then the smallest k."""
    return (grid.orderBy(F.round(objective, TIE_DIGITS).desc(), "metric", "weights", "k").first().asDict())


def holdout_votes(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str], cell: dict) -> DataFrame:
    """(key, label, p, pred) of the test rows, voted by the training rows with a cell's setting."""
    run = "__run"
    nn = ranked(test.withColumn(run, F.lit(0)), train.withColumn(run, F.lit(0)), key, label, features, run, cell["k"], cell["metric"])
    return votes(nn, key, run, label).where((F.col("k") == cell["k"]) & (F.col("weights") == cell["weights"])).select(key, label, "p", "pred")
