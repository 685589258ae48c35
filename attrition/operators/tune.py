"""Hyper-parameter search, cross-validation and leaderboards (F6, T1–T3,
V9, V10, G3).

* Search spaces are declared as a dict of draws; trial ``i``'s values are
  hash-uniform functions of ``(seed, i, name)`` (F6), so a study is
  reproducible and the same numbers can be produced in SQL.
* Trials are fitted concurrently from a driver thread pool (as MLlib's
  ``CrossValidator(parallelism=…)`` does); each fit is a distributed job.
* Objectives take the validation predictions DataFrame and return a metric
  and a threshold (G3) – e.g. the constrained threshold sweep of V6.
* Resampling happens inside each training fold, never before the split.
"""

from __future__ import annotations

import hashlib
import math
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform
from attrition.operators import boost, metrics
from attrition.session import cut_lineage


# --- F6 draws ---------------------------------------------------------------

@dataclass(frozen=True)
class Draw:
    kind: str                 # "int", "uniform", "loguniform", "categorical"
    lo: float = 0.0
    hi: float = 1.0
    choices: tuple = ()


def uniform_py(seed: int, *parts) -> float:
    """Driver-side twin of ``hash_uniform`` (same bits)."""
    text = "|".join([str(seed)] + [str(p) for p in parts])
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 4294967296.0


def draw_value(d: Draw, u: float):
    if d.kind == "int":
        return int(d.lo + math.floor(u * (d.hi - d.lo + 1)))
    if d.kind == "uniform":
        return d.lo + u * (d.hi - d.lo)
    if d.kind == "loguniform":
        return math.exp(math.log(d.lo) + u * (math.log(d.hi) - math.log(d.lo)))
    if d.kind == "categorical":
        return d.choices[int(math.floor(u * len(d.choices)))]
    raise ValueError(d.kind)


def draw_col(d: Draw, u: Column) -> Column:
    """F6 as a column expression of a uniform column."""
    if d.kind == "int":
        return (F.lit(d.lo) + F.floor(u * (d.hi - d.lo + 1))).cast("int")
    if d.kind == "uniform":
        return F.lit(d.lo) + u * F.lit(d.hi - d.lo)
    if d.kind == "loguniform":
        return F.exp(F.lit(math.log(d.lo)) + u * F.lit(math.log(d.hi) - math.log(d.lo)))
    if d.kind == "categorical":
        return F.element_at(F.array(*[F.lit(c) for c in d.choices]), F.floor(u * len(d.choices)).cast("int") + 1)
    raise ValueError(d.kind)


def trials(space: dict[str, Draw], n: int, seed: int = 42) -> list[dict]:
    """Parameter sets of ``n`` trials (driver-side, n is the search budget)."""
    return [{name: draw_value(d, uniform_py(seed, i, name)) for name, d in space.items()} for i in range(n)]


def trial_columns(df: DataFrame, space: dict[str, Draw], seed: int = 42, trial: str = "trial") -> DataFrame:
    """Adds one column per parameter, drawn for the trial index in ``trial``
    (an md5 per row; use :func:`explode_trials` when rows × trials is big)."""
    out = df
    for name, d in space.items():
        out = out.withColumn(name, draw_col(d, hash_uniform(seed, trial, F.lit(name))))
    return out


def explode_trials(df: DataFrame, space: dict[str, Draw], n: int, seed: int = 42,
                   trial: str = "trial") -> DataFrame:
    """Every row once per trial, with the trial's parameters.  The n trial
    draws (the search budget) are computed once on the driver – the same
    bits as the column form – and inlined, so rows × trials costs no hash
    and no join."""
    ps = trials(space, n, seed)
    structs = [F.struct(F.lit(i).alias(trial), *[F.lit(p[k]).alias(k) for k in space]) for i, p in enumerate(ps)]
    return df.select("*", F.explode(F.array(*structs)).alias("__t")).select(
        *df.columns, *[F.col(f"__t.{c}").alias(c) for c in [trial, *space]])


# --- T2 random search ---------------------------------------------------------

def sweep_objective(metric: str = "f1", min_precision: float | None = 0.5, min_recall: float | None = None,
                    lo: float = 0.1, hi: float = 0.9, step: float = 0.01, label: str = "label"):
    """Best constrained metric over a threshold grid → (value, threshold)."""
    def objective(pred: DataFrame) -> tuple[float, float]:
        curve = metrics.threshold_curve(pred, "p", label, lo, hi, step)
        best = metrics.best_threshold(curve, metric, min_precision=min_precision,
                                      min_recall=min_recall).first()
        return float(best["value"]), float(best["threshold"])
    return objective


def random_search(make_estimator: Callable[[dict], object], space: dict[str, Draw], n_trials: int,
                  train: DataFrame, valid: DataFrame, key, label: str,
                  objective: Callable[[DataFrame], tuple[float, float]],
                  seed: int = 42, parallelism: int = 4) -> tuple[DataFrame, dict]:
    """Seeded random search scored on a validation split.  Returns the
    trials table (trial, params, value, threshold) and the best trial
    (first on ties)."""
    from attrition.operators.models import fit_all, score, score_all
    params = trials(space, n_trials, seed)
    fitted = fit_all([make_estimator(p) for p in params], train)
    scored = score_all(fitted, valid, key, label, parallelism) if fitted else None

    def run(i: int):
        value, thr = objective(scored[i] if scored else score(make_estimator(params[i]).fit(train), valid, key, label))
        return i, value, thr

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = sorted(pool.map(run, range(n_trials)))
    spark = train.sparkSession
    rows = [(i, {k: str(v) for k, v in params[i].items()}, v, t) for i, v, t in results]
    table = spark.createDataFrame(rows, "trial int, params map<string,string>, value double, threshold double")
    best_i, best_v, best_t = max(results, key=lambda r: (r[1], -r[0]))
    return table, {"trial": best_i, "params": params[best_i], "value": best_v, "threshold": best_t}


def halving_search(make_estimator: Callable[[dict], object], space: dict[str, Draw], n_trials: int, train: DataFrame, valid: DataFrame, key, label: str,
                   objective: Callable[[DataFrame], tuple[float, float]], resource: str = "n_estimators", keep: int = 3, rungs: int = 3,
                   seed: int = 42, parallelism: int = 4) -> tuple[DataFrame, dict, object]:
    """T2 by successive halving: all trials start with a share ``keep ** -(rungs - 1)`` of
    their own ``resource`` (trees, rounds); on each rung the best ``1 / keep`` of them go on
    with ``keep`` times as much, the last rung with all of it.  Returns the table (trial,
    rung, resource, params, value, threshold), the winner and its fitted model: the best
    trial of the last rung, the first on ties."""
    from attrition.operators.models import fit_all, score, score_all
    params = trials(space, n_trials, seed)
    alive, rows, best = list(range(n_trials)), [], None
    for rung in range(rungs):
        share = keep ** -(rungs - 1 - rung)
        own = [params[i] | {resource: max(1, round(params[i][resource] * share))} for i in alive]
        fitted = fit_all([make_estimator(p) for p in own], train)
        scored = score_all(fitted, valid, key, label, parallelism) if fitted else None

        def run(at: int):
            model = fitted[at] if fitted else make_estimator(own[at]).fit(train)
            return alive[at], own[at], model, *objective(scored[at] if scored else score(model, valid, key, label))

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            done = sorted(pool.map(run, range(len(alive))), key=lambda r: (-r[3], r[0]))
        rows += [(i, rung, int(own[resource]), {k: str(v) for k, v in params[i].items()}, value, thr) for i, own, _, value, thr in done]
        best = done[0]
        alive = sorted(r[0] for r in done[:max(1, math.ceil(len(done) / keep))])
    table = train.sparkSession.createDataFrame(rows, "trial int, rung int, resource int, params map<string,string>, value double, threshold double")
    i, own, model, value, thr = best
    return table, {"trial": i, "params": own, "value": value, "threshold": thr}, model


# --- T1 grid search with k-fold CV ----------------------------------------------

def grid_search(pipeline, grid: dict, train: DataFrame, label: str = "label", fold_col: str = "fold",
                parallelism: int = 4, metric: str = "accuracy", num_folds: int = 5):
    """Exhaustive grid scored by k-fold CV over an existing fold
    column; the best setting is refit on all training rows."""
    est = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        if values:                   # an empty list keeps the estimator's own value
            builder = builder.addGrid(est.getParam(name), list(values))
    maps = builder.build()
    ev = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col,
                        numFolds=num_folds, parallelism=parallelism, seed=42)
    model = cv.fit(train)
    rows = [({p.name: str(v) for p, v in m.items()}, float(a), float(s))
            for m, a, s in zip(maps, model.avgMetrics, model.stdMetrics)]
    table = train.sparkSession.createDataFrame(rows, "params map<string,string>, cv_mean double, cv_std double")
    return model.bestModel, table


# --- V9 cross-validated scores with resampling inside folds ---------------------------

def cv_scores(make_pipeline: Callable[[], object], df: DataFrame, key, label: str, k: int = 5,
              fold_col: str = "fold", resample: Callable[[DataFrame], DataFrame] | None = None,
              threshold: float = 0.5, parallelism: int = 4) -> DataFrame:
    """Per-fold metrics (accuracy, average precision, ROC AUC, macro F1)
    of a pipeline; ``resample`` (e.g. SMOTE) runs on each training fold only.
    Folds are fitted concurrently (each fit is a distributed job)."""
    from attrition.operators.models import score

    def run(f: int):
        tr = df.where(F.col(fold_col) != f)
        te = df.where(F.col(fold_col) == f)
        if resample is not None:
            # stored: a fit reads its rows several times, and each time would search neighbours again
            tr = cut_lineage(resample(tr))
        model = make_pipeline().fit(tr)
        pred = score(model, te, key, label).persist()
        try:
            hard = (F.col("p") >= threshold).cast("int")
            ranked = metrics.rank_metrics(pred, "p", label).first()
            row = (metrics.prf(pred, label, hard).first()["accuracy"], ranked["ap"], ranked["auc"],
                   metrics.macro_f1(pred, label, hard).first()[0])
        finally:
            pred.unpersist()
        return (f, *[float(x) if x is not None else None for x in row])

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        out = sorted(pool.map(run, range(k)))
    return df.sparkSession.createDataFrame(
        out, "fold int, accuracy double, average_precision double, roc_auc double, macro_f1 double")


METRIC_COLS = ["tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "roc_auc", "ap"]


def evaluate_row(pred: DataFrame, label: str, threshold: float = 0.5) -> dict:
    """T3 report: hold-out metrics of a score table, as one dict (one row
    back per aggregate)."""
    hard = (F.col("p") >= threshold).cast("int")
    pred = pred.persist()
    try:
        m = metrics.prf(pred, label, hard).first().asDict()
        m["roc_auc"], m["ap"] = metrics.rank_metrics(pred, "p", label).first()
    finally:
        pred.unpersist()
    return {c: m[c] for c in METRIC_COLS}


@dataclass(frozen=True)
class Candidate:
    """A model of the comparison: its settings, and a function from training rows and
    rows to score to scored rows (key, label, ``p``, ``pred``).  ``predict_all`` does
    the same for all fits at once, told apart by a column ``fit`` in rows and result."""
    params: dict
    predict: Callable[[DataFrame, DataFrame], DataFrame]
    predict_all: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None


def estimator(params: dict, make: Callable[[DataFrame], object], key, label: str) -> Candidate:
    """Candidate of an MLlib pipeline; ``make`` builds it for the training rows."""
    from attrition.operators.models import score
    return Candidate(params, lambda tr, te: score(make(tr).fit(tr), te, key, label))


class SharedEdges:
    """Bin edges of the rows that several candidates train on, found once."""

    def __init__(self) -> None:
        self.lock, self.found = threading.Lock(), {}

    def of(self, train: DataFrame, features: list[str], max_bins: int) -> list[tuple[float, ...]]:
        with self.lock:
            key = (id(train), *features, max_bins)
            if key not in self.found:
                self.found[key] = train, boost.bin_edges(train, features, max_bins)    # the rows are kept: so is their id
            return self.found[key][1]


def boosted(params: dict, p: boost.Boosting, features: list[str], key: str, label: str, weight: str | None = None,
            shared: SharedEdges | None = None) -> Candidate:
    """Candidate of :mod:`boost`: all fits grow in the same passes."""
    def all_fits(train: DataFrame, held: DataFrame, fits: int) -> DataFrame:
        edges = shared.of(train, features, p.max_bins) if shared else None
        return boost.score_many(boost.fit_many(train, key, features, label, p, weight, "fit", fits, edges=edges), held, key, label, "fit")

    def one(train: DataFrame, held: DataFrame) -> DataFrame:
        return boost.score_many(boost.fit_many(train, key, features, label, p, weight), held, key, label)

    return Candidate(params, one, all_fits)


#: Training rows of a partition of the stored fits.
FIT_ROWS = 1 << 17


def all_fits(train: DataFrame, test: DataFrame, fold_col: str, folds: int, resample: Callable[[DataFrame], DataFrame] | None = None,
             parallelism: int = 4) -> tuple[DataFrame, DataFrame]:
    """Training rows and rows to score of every fit, stored once: fit ``f`` trains on the
    other folds and scores fold ``f``; fit ``folds`` trains on all rows and scores
    ``test``.  ``resample`` sees the training rows of one fit only."""
    def rows(f: int) -> DataFrame:
        own = (train if f == folds else train.where(F.col(fold_col) != f)).drop(fold_col)
        # stored before it is counted: either would search neighbours again
        own = (own if resample is None else cut_lineage(resample(own))).withColumn("fit", F.lit(f))
        return cut_lineage(own.repartition(max(1, own.count() // FIT_ROWS)))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(rows, range(folds + 1)))
    trained = parts[0]
    for more in parts[1:]:
        trained = trained.unionByName(more)
    columns = [c for c in test.columns if c in train.columns and c != fold_col]
    held = train.select(*columns, F.col(fold_col).cast("int").alias("fit")).unionByName(test.select(*columns, F.lit(folds).alias("fit")))
    return trained, cut_lineage(held.repartition(max(1, held.count() // FIT_ROWS)))


def compare(candidates: dict[str, Candidate], train: DataFrame, test: DataFrame, label: str, fold_col: str = "fold",
            folds: int = 5, threshold: float = 0.5, parallelism: int = 4, resample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per model with its settings, the mean and population std
    of its cross-validated accuracy, and all hold-out metrics.  Training rows of each
    fit are resampled after the folds are made, so no synthetic row has a parent in
    the fold that scores it.  Fits run concurrently, over tables stored once."""
    fit_rows, held_rows = all_fits(train, test, fold_col, folds, resample, parallelism)

    def accuracy(pred: DataFrame) -> dict[int, float]:
        right = (F.col(label) == (F.col("p") >= threshold).cast("int")).cast("double")
        return {r.fit: r.a for r in pred.groupBy("fit").agg(F.avg(right).alias("a")).collect()}

    def one(c: Candidate, f: int):
        pred = c.predict(fit_rows.where(F.col("fit") == f).drop("fit"), held_rows.where(F.col("fit") == f).drop("fit")).withColumn("fit", F.lit(f))
        return accuracy(pred) if f < folds else evaluate_row(pred, label, threshold)

    def every(c: Candidate):
        pred = cut_lineage(c.predict_all(fit_rows, held_rows, folds + 1))
        return [accuracy(pred.where(F.col("fit") < folds)), evaluate_row(pred.where(F.col("fit") == folds), label, threshold)]

    # the longest first: a boosting fit is a chain of passes
    order = sorted(candidates, key=lambda n: (candidates[n].predict_all is None, -int(candidates[n].params.get("n_estimators", 0)), n))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        jobs = {n: [pool.submit(every, candidates[n])] if candidates[n].predict_all else
                [pool.submit(one, candidates[n], f) for f in range(folds + 1)] for n in order}
        rows = []
        for n in sorted(candidates):
            got = jobs[n][0].result() if candidates[n].predict_all else [j.result() for j in jobs[n]]
            by_fold = {f: a for part in got[:-1] for f, a in part.items()}
            scores = [by_fold[f] for f in sorted(by_fold) if by_fold[f] is not None]
            mean = sum(scores) / len(scores) if scores else None
            std = math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores)) if scores else None
            rows.append((n, {k: str(v) for k, v in candidates[n].params.items()}, mean, std, *[got[-1][m] for m in METRIC_COLS]))
    return train.sparkSession.createDataFrame(
        rows, "model string, params map<string,string>, cv_mean double, cv_std double, tn bigint, fp bigint, fn bigint, tp bigint, "
        + ", ".join(f"{c} double" for c in METRIC_COLS[4:]))


def leaderboard(models: dict[str, Callable[[], object]], train: DataFrame, test: DataFrame, key,
                label: str, threshold: float = 0.5, parallelism: int = 4) -> DataFrame:
    """Fit every model (concurrently), one metrics row each.  A model is an
    estimator, or a :class:`Candidate` where MLlib has none."""
    from attrition.operators.models import score

    def run(name):
        made = models[name]()
        pred = made.predict(train, test) if isinstance(made, Candidate) else score(made.fit(train), test, key, label)
        return name, evaluate_row(pred, label, threshold)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        res = list(pool.map(run, sorted(models)))
    cols = METRIC_COLS
    rows = [(n, *[r[c] for c in cols]) for n, r in res]
    schema = "model string, tn bigint, fp bigint, fn bigint, tp bigint, " + \
        ", ".join(f"{c} double" for c in cols[4:])
    return train.sparkSession.createDataFrame(rows, schema)
