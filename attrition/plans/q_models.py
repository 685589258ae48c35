"""Model, tuning and explanation queries.

SQL-checkable: the seeded search mechanics (F6/T2/O2) over the ensemble of
two formula scores, and exact linear attributions (X1–X4).  Rows-only: the
MLlib fits (M1–M12), cross-validation (V9), grid and random search (T1–T3),
the leaderboard (V10) and sampled Shapley values (X1), on the documents ⋈
labels view whose label is learnable.  Tree counts, depths, rounds and search
ranges are the workload's own (the budgets of the workflows).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.functions.hashing import duckdb_uniform, hash_uniform
from attrition.operators import boost, encode, explain, metrics, models, neighbors, resample, split, tune
from attrition.plans.pipelines import ComparisonBudget, EnsembleBudget, SegmentationBudget
from attrition.plans.q_neighbors import FEAT_SQL, FEATS, features
from attrition.plans.registry import query
from attrition.session import cut_lineage
from attrition.sources.views import CHURN_SQL, LINE_SQL, doc_view, line_view, with_views

# --- seeded search over the two-score ensemble (SQL-checkable) --------------------

SPACE = {"w": tune.Draw("uniform", 0.1, 0.9), "t": tune.Draw("uniform", 0.3, 0.7)}
N_TRIALS = 20


def _trial_curve(spark, sf_dir):
    li = line_view(spark, sf_dir).select("s_qty", "s_price", "label")
    rows = tune.explode_trials(li, SPACE, N_TRIALS, seed=42)
    p = metrics.ensemble_prob(F.col("s_qty"), F.col("s_price"), F.col("w"), 1.0 - F.col("w"))
    m = metrics.prf(rows, "label", (p >= F.col("t")).cast("int"), by=["trial", "w", "t"])
    return m.select("trial", "w", "t", "precision", "recall", "f1")


def _trial_sql() -> str:
    def draw(name, d):
        return f"{d.lo!r}::DOUBLE + {duckdb_uniform(42, 'trial', repr(name))} * {d.hi - d.lo!r}::DOUBLE"
    return f"""
tr AS (SELECT CAST(range AS INTEGER) AS trial FROM range(0, {N_TRIALS})),
tp AS (SELECT trial, {draw('w', SPACE['w'])} AS w, {draw('t', SPACE['t'])} AS t FROM tr),
c AS (SELECT trial, w, t,
             count(*) FILTER (WHERE label = 1 AND (s_qty * w + s_price * (1.0 - w)) / (w + (1.0 - w)) >= t) AS tp,
             count(*) FILTER (WHERE label = 0 AND (s_qty * w + s_price * (1.0 - w)) / (w + (1.0 - w)) >= t) AS fp,
             count(*) FILTER (WHERE label = 1 AND (s_qty * w + s_price * (1.0 - w)) / (w + (1.0 - w)) < t) AS fn
      FROM line, tp GROUP BY trial, w, t),
r AS (SELECT trial, w, t,
             CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
             CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c)"""


@query("trial_table", with_views(_trial_sql() + """
SELECT trial, round(w, 6) AS w, round(t, 6) AS t, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r""", LINE_SQL), ops="F6 T2 J4")
def trial_table(spark, sf_dir):
    return _trial_curve(spark, sf_dir)


@query("random_search_best", with_views(_trial_sql() + """
SELECT trial, round(w, 6) AS w, round(t, 6) AS t, round(f1, 6) AS f1 FROM r
WHERE recall >= 0.5 ORDER BY f1 DESC, trial LIMIT 1""", LINE_SQL), ops="T2 O2 G3")
def random_search_best(spark, sf_dir):
    c = _trial_curve(spark, sf_dir).where(F.col("recall") >= 0.5)
    return c.orderBy(F.desc("f1"), "trial").limit(1).select("trial", "w", "t", "f1")


# --- exact linear attributions on churn features (SQL-checkable) -------------------

def _attr(spark, sf_dir):
    f = features(spark, sf_dir)
    w = explain.slope_weights(f, FEATS, "exited")
    return explain.linear_attribution(f, "c_custkey", FEATS, w), f, w


ATTR_SQL = FEAT_SQL + """,
wt AS (SELECT """ + ", ".join(f"covar_pop({c}, CAST(exited AS DOUBLE)) / var_pop({c}) AS w_{c}, avg({c}) AS m_{c}"
                              for c in FEATS) + """ FROM feat),
att AS (""" + " UNION ALL ".join(
    f"SELECT c_custkey, '{c}' AS feature, {c} AS value, w_{c} * ({c} - m_{c}) AS phi FROM feat, wt"
    for c in FEATS) + ")"


@query("linear_attribution", with_views(ATTR_SQL + """
SELECT c_custkey, feature, round(value, 6) AS value, round(phi, 6) AS phi FROM att""", CHURN_SQL), ops="X1 F1")
def linear_attribution(spark, sf_dir):
    return _attr(spark, sf_dir)[0]


@query("mean_abs_attribution", with_views(ATTR_SQL + """
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM att GROUP BY feature""", CHURN_SQL),
    ops="X2 A17 F1 O1")
def mean_abs_attribution(spark, sf_dir):
    return explain.mean_abs_attribution(_attr(spark, sf_dir)[0]).orderBy(F.desc("mean_abs_phi"))


@query("waterfall_row", with_views(ATTR_SQL + """,
one AS (SELECT * FROM att WHERE c_custkey = (SELECT min(c_custkey) FROM feat)),
base AS (SELECT """ + " + ".join(f"w_{c} * m_{c}" for c in FEATS) + """ AS b FROM wt)
SELECT c_custkey, feature, round(value, 6) AS value, round(phi, 6) AS phi,
       CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS step,
       round(b + sum(phi) OVER (ORDER BY abs(phi) DESC, feature ROWS UNBOUNDED PRECEDING), 6) AS running
FROM one, base""", CHURN_SQL), ops="X3")
def waterfall_row(spark, sf_dir):
    att, f, w = _attr(spark, sf_dir)
    row = f.agg(F.min("c_custkey").alias("k"), *[F.avg(c).alias(c) for c in FEATS]).first()
    base = sum(w[c] * row[c] for c in FEATS)
    return explain.waterfall(att, F.col("c_custkey") == row["k"], base)


@query("attribution_by_value", with_views(ATTR_SQL + """,
rg AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM att GROUP BY feature)
SELECT feature, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) * 10 / (mx - mn)), 9) END AS INTEGER)
         AS bin, round(avg(phi), 6) AS mean_phi, count(*) AS n
FROM att JOIN rg USING (feature) GROUP BY ALL""", CHURN_SQL), ops="X4")
def attribution_by_value(spark, sf_dir):
    return explain.attribution_by_value(_attr(spark, sf_dir)[0], 10)


# --- MLlib fits on the document view (rows-only) --------------------------------------

COMPARISON, ENSEMBLE, SEGMENTATION = ComparisonBudget(), EnsembleBudget(), SegmentationBudget()
DOC_FEATS = ["log_len", "non_letter_share", "n_words", "digit_share", "distinct_ratio"]


def _doc_split(spark, sf_dir):
    # text features are computed once per query (whole texts), then reused by fit and scoring
    d = cut_lineage(doc_view(spark, sf_dir).withColumn("label", F.col("quality").cast("int")))
    u = hash_uniform(42, "doc_id")
    return d.where(u >= 0.3), d.where(u < 0.3)


def _fit_eval(spark, sf_dir, name: str, make, weighted: dict | str | None = None):
    """``make`` gets the training rows' number and the training rows."""
    tr, te = _doc_split(spark, sf_dir)
    if weighted is not None:
        tr = metrics.with_weights(tr, "label", weighted, "weight")
    model = make(tr.count(), tr).fit(tr)
    return _report(spark, name, models.score(model, te, "doc_id", "label"))


def _report(spark, name: str, pred):
    r = tune.evaluate_row(pred, "label", 0.5)
    cols = tune.METRIC_COLS
    schema = "model string, tn bigint, fp bigint, fn bigint, tp bigint, " + \
        ", ".join(f"{c} double" for c in cols[4:])
    return spark.createDataFrame([(name, *[r[c] for c in cols])], schema)


@query("fit_logreg", ops="M1 M11 T3 V2 V4 V5")
def fit_logreg(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "logreg",
                     lambda n, tr: models.pipeline(DOC_FEATS, models.logistic(C=1.0, n=n, max_iter=100)))


@query("fit_tree", ops="M2 M11")
def fit_tree(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "tree",
                     lambda n, tr: models.pipeline(DOC_FEATS, models.tree(max_depth=5, min_samples_leaf=2,
                                                                      weight_col="weight")), "balanced")


@query("fit_tree_log2", ops="M2")
def fit_tree_log2(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "tree_log2",
                     lambda n, tr: models.pipeline(DOC_FEATS, models.tree(max_depth=6, max_features="log2")))


@query("fit_forest", ops="M3 M11")
def fit_forest(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "forest",
                     lambda n, tr: models.pipeline(DOC_FEATS, models.forest(**COMPARISON.forest)))


@query("fit_gbt", ops="M4 M11")
def fit_gbt(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "gbt",
                     lambda n, tr: models.pipeline(DOC_FEATS, models.boosting(**COMPARISON.boosting, subsample=0.8)))


@query("fit_gbt_weighted", ops="M5 P7")
def fit_gbt_weighted(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "gbt_xgb_style",
                     lambda n, tr: models.pipeline(DOC_FEATS, models.boosting_xgb_style(
                         **COMPARISON.xgb_style, subsample=0.8, colsample_bytree=0.8, weight_col="weight")), {0: 1.0, 1: 2.0})


@query("fit_gbt_leafwise", ops="M6")
def fit_gbt_leafwise(spark, sf_dir):
    tr, te = _doc_split(spark, sf_dir)
    models_ = boost.fit_many(tr, "doc_id", DOC_FEATS, "label", models.leafwise(**COMPARISON.leafwise_style))
    return _report(spark, "gbt_leafwise_style", boost.score_many(models_, te, "doc_id", "label"))


@query("fit_gbt_nominal", ops="M7 P7")
def fit_gbt_nominal(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "gbt_nominal",
                     lambda n, tr: models.nominal_boosting_pipeline(DOC_FEATS, ["lang", "source"], weight_col="weight", **ENSEMBLE.boosting,
                                                                    max_levels=models.most_levels(tr, ["lang", "source"])), {0: 0.32, 1: 0.68})


def _svc(kernel: str, **options):
    return lambda n, tr: models.svc_pipeline(DOC_FEATS, kernel, C=1.0, n=n, scaling=models.standard_constants(tr, DOC_FEATS), **options)


@query("fit_linear_svc", ops="M8")
def fit_linear_svc(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "linear_svc", _svc("linear"))


@query("fit_rff_svc", ops="M8")
def fit_rff_svc(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "rbf_svc", _svc("rbf"))


@query("fit_poly_svc", ops="M8")
def fit_poly_svc(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "poly_svc", _svc("poly", degree=3))


@query("importances", ops="M12 O1")
def importances(spark, sf_dir):
    tr, _ = _doc_split(spark, sf_dir)
    model = models.pipeline(DOC_FEATS, models.forest(**SEGMENTATION.forest)).fit(tr)
    return models.importances(model, DOC_FEATS)


@query("cv_scores", ops="V9 A16 D3 R1")
def cv_scores(spark, sf_dir):
    """5-fold CV of a logistic model on churn features, SMOTE inside each
    training fold; per-fold scores and their mean/std."""
    # stored: every fold trains and scores on parts of it
    f = cut_lineage(split.kfold_hash(features(spark, sf_dir), "c_custkey", 5).withColumn("label", F.col("exited")))
    n = f.count()

    def resample_fold(tr):
        s = resample.smote(tr.drop("r_name", "c_mktsegment"), "c_custkey", "exited", FEATS, k=5)
        return s.withColumn("label", F.col("exited"))

    per_fold = tune.cv_scores(lambda: models.pipeline(FEATS, models.logistic(1.0, n, 50)), f,
                              "c_custkey", "label", 5, resample=resample_fold)
    from attrition.operators.profile import fold_summary
    long = per_fold.unpivot(["fold"], ["accuracy", "average_precision", "roc_auc", "macro_f1"], "metric", "value")
    return fold_summary(long, ["metric"], "value")


#: The workload's own forest (100 trees of 20 levels) and smaller ones beside it.
FOREST_GRID = {"maxDepth": [3, 5, COMPARISON.forest["max_depth"]], "numTrees": [10, 20, COMPARISON.forest["n_estimators"]], "minInstancesPerNode": []}
FOREST_SPACE = {"n_estimators": tune.Draw("int", *ENSEMBLE.n_estimators), "max_depth": tune.Draw("int", *ENSEMBLE.max_depth),
                "min_samples_leaf": tune.Draw("int", 1, 10), "max_features": tune.Draw("categorical", choices=("sqrt", "log2"))}
#: Background rows of each sampled Shapley value.  A row's differences lie in
#: [-1, 1], so its standard error is at most 1 / sqrt(400) = 0.05; the measured one is in the result.
N_PERM = 400


@query("grid_search", ops="T1 T3")
def grid_search(spark, sf_dir):
    tr, _ = _doc_split(spark, sf_dir)
    tr = split.kfold_hash(tr, "doc_id", 5)
    pipe = models.pipeline(DOC_FEATS, models.forest(**COMPARISON.forest))
    _, table = tune.grid_search(pipe, FOREST_GRID,
                                tr, "label", "fold", parallelism=4, num_folds=5)
    return table


@query("random_search", ops="T2 T3 G3 F6")
def random_search(spark, sf_dir):
    tr, te = _doc_split(spark, sf_dir)
    tr = cut_lineage(metrics.with_weights(tr, "label", "balanced", "weight"))

    def make(p):
        return models.pipeline(DOC_FEATS, models.forest(**p, weight_col="weight"))

    table, _ = tune.random_search(make, FOREST_SPACE, ENSEMBLE.trials, tr, te, "doc_id", "label",
                                  tune.sweep_objective("f1", min_precision=0.5, min_recall=0.8),
                                  seed=42, parallelism=4)
    return table


@query("leaderboard", ops="V10 T3")
def leaderboard(spark, sf_dir):
    tr, te = _doc_split(spark, sf_dir)
    tr = cut_lineage(metrics.with_weights(tr, "label", COMPARISON.class_weights, "weight"))
    return tune.leaderboard(_board(tr), tr, te, "doc_id", "label")


def _board(tr):
    """The nine models of the comparison, for the training rows ``tr``."""
    b, n = COMPARISON, tr.count()

    def nearest(rows, held):
        scale = encode.fit_minmax(rows, DOC_FEATS).transform
        p = neighbors.knn_classify(scale(rows), scale(held), "doc_id", "label", DOC_FEATS, **b.knn)
        return held.select("doc_id", "label").join(p, "doc_id")

    return {
        "logreg": lambda: models.pipeline(DOC_FEATS, models.logistic(n=n, **b.logistic)),
        "tree": lambda: models.pipeline(DOC_FEATS, models.tree(**b.tree)),
        "forest": lambda: models.pipeline(DOC_FEATS, models.forest(**b.forest)),
        "knn": lambda: tune.Candidate(b.knn, nearest),
        "svm": lambda: models.svc_pipeline(DOC_FEATS, "rbf", n=n, scaling=models.standard_constants(tr, DOC_FEATS), **b.svm),
        "gbt": lambda: models.pipeline(DOC_FEATS, models.boosting(**b.boosting)),
        "gbt_xgb_style": lambda: models.pipeline(DOC_FEATS, models.boosting_xgb_style(**b.xgb_style)),
        "gbt_leafwise_style": lambda: tune.boosted(b.leafwise_style, models.leafwise(**b.leafwise_style), DOC_FEATS, "doc_id", "label"),
        "gbt_weighted_style": lambda: tune.boosted(b.weighted_style, models.levelwise(**b.weighted_style), DOC_FEATS, "doc_id", "label", "weight"),
    }


@query("shapley_sampled", ops="X1 X2 D2")
def shapley_sampled(spark, sf_dir):
    tr, te = _doc_split(spark, sf_dir)
    model = models.pipeline(DOC_FEATS, models.forest(**COMPARISON.forest)).fit(tr)
    sample = split.sample_n(te, "doc_id", 500)
    phi = explain.sampled_shapley(model, sample, tr, "doc_id", DOC_FEATS, n_perm=N_PERM)
    error = phi.groupBy("feature").agg(F.sqrt(F.avg(F.col("se") * F.col("se"))).alias("row_se"))
    return explain.mean_abs_attribution(phi).join(error, "feature").orderBy(F.desc("mean_abs_phi"), "feature")
