"""The three end-to-end workflows, composed from the operators.

1. model comparison: clean → encode → split → scale (train-fitted) →
   folds → SMOTE on each fit's training rows only → nine classifiers, each
   cross-validated and scored on the hold-out;
2. ensemble: train / validation / unlabelled split → an encoded branch
   (SMOTE, forest search by successive halving with a constrained threshold sweep) and a
   nominal branch (SMOTE-NC, nominal boosting with class weights) → the
   weight × threshold grid on validation → scoring of the unlabelled set;
3. segmentation: importances → elbow → k-means → cluster profiles, for all
   customers and for churned customers only.

How much work a run does is an argument.  The defaults are the workload's own
settings, and the registered queries run with them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform
from attrition.operators import clean, encode, metrics, models, neighbors, profile, resample, segment, split, tune
from attrition.plans.registry import query
from attrition.session import cut_lineage
from attrition.sources.views import churn_view


#: The settings in the three budgets below are the workload's own.


@dataclass(frozen=True)
class ComparisonBudget:
    """Settings of the nine models, by the parameter names of :mod:`models`."""
    folds: int = 5
    logistic: dict = field(default_factory=lambda: {"C": 1.0, "max_iter": 100})
    tree: dict = field(default_factory=lambda: {"max_depth": 7, "min_samples_leaf": 15})
    forest: dict = field(default_factory=lambda: {"n_estimators": 100, "max_depth": 20})
    knn: dict = field(default_factory=lambda: {"k": 1, "metric": "manhattan", "weights": "uniform"})
    svm: dict = field(default_factory=lambda: {"C": 1000.0, "n_components": 100})
    boosting: dict = field(default_factory=lambda: {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3})
    xgb_style: dict = field(default_factory=lambda: {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6})
    leafwise_style: dict = field(default_factory=lambda: {
        "n_estimators": 730, "max_depth": 13, "learning_rate": 0.01435834368105083, "num_leaves": 9, "min_child_samples": 106,
        "min_child_weight": 2.6604198671232178, "subsample": 0.841433063340509, "colsample_bytree": 0.9187535635349607,
        "reg_alpha": 5.834179034203318, "reg_lambda": 1.4776579289686835})
    weighted_style: dict = field(default_factory=lambda: {
        "n_estimators": 111, "learning_rate": 0.02678152407579277, "max_depth": 8, "reg_lambda": 0.0008386712970316092})
    class_weights: dict = field(default_factory=lambda: {0: 0.35, 1: 0.65})


@dataclass(frozen=True)
class EnsembleBudget:
    """Trials and ranges of the forest search, and the boosting's settings.  The
    search's depth range ends at the 30 levels that MLlib builds."""
    trials: int = 30
    n_estimators: tuple[int, int] = (100, 500)
    max_depth: tuple[int, int] = (3, 30)
    boosting: dict = field(default_factory=lambda: {"n_estimators": 111, "learning_rate": 0.02678152407579277, "depth": 8})


@dataclass(frozen=True)
class SegmentationBudget:
    k_max: int = 10
    forest: dict = field(default_factory=lambda: {"n_estimators": 213, "max_depth": 29, "min_samples_leaf": 9})


FEATS = ["c_acctbal", "n_orders", "spend", "n_prio"]
NOMINAL = ["r_name", "c_mktsegment"]


def _clean_churn(spark, sf_dir) -> DataFrame:
    ch = clean.dropna_any(churn_view(spark, sf_dir), FEATS)
    return clean.dedup_keep_first(ch, FEATS + NOMINAL + ["exited"], "c_custkey").drop("c_name")


def _in_fewer(df: DataFrame) -> DataFrame:
    """A stored table read by as many tasks as its rows need; a small one as it is."""
    n = df.count()
    return df if n < tune.FIT_ROWS else df.coalesce(n // tune.FIT_ROWS)


def _by_rows(df: DataFrame) -> DataFrame:
    """Stored once, in as many partitions as its rows need: each of the many passes of a
    fit starts a task per partition."""
    df = cut_lineage(df)
    return cut_lineage(df.repartition(max(1, df.count() // tune.FIT_ROWS)))


def comparison(spark, sf_dir, seed: int = 42, budget: ComparisonBudget | None = None) -> DataFrame:
    """One row per model: settings, cross-validated accuracy, hold-out metrics."""
    b = budget or ComparisonBudget()
    ch = _in_fewer(cut_lineage(split.split_hash(_clean_churn(spark, sf_dir), "c_custkey", 0.3, seed)))
    train, test = ch.where(split.in_split("train")), ch.where(split.in_split("test"))
    prep = encode.fit_prep(train, label_cols=["c_mktsegment"], one_hot_cols=["r_name"], scale_cols=FEATS)
    oh = prep.one_hots[0].names()
    # the segment's code is scaled to [0, 1] too, so that no code outweighs the measures
    codes = encode.fit_minmax(prep.transform(train), ["c_mktsegment"])
    feats = FEATS + ["c_mktsegment"] + oh
    tr = codes.transform(prep.transform(train)).select(F.col("c_custkey").cast("string").alias("row_key"), *feats, F.col("exited").alias("label"))
    te = codes.transform(prep.transform(test)).select(F.col("c_custkey").cast("string").alias("row_key"), *feats, F.col("exited").alias("label"))
    tr = _in_fewer(cut_lineage(split.kfold_hash(tr, "row_key", b.folds, seed)))

    def oversampled(rows: DataFrame) -> DataFrame:
        """Of one fit's training rows: the folds are made before, as in :func:`tune.cv_scores`."""
        made = resample.smote(rows.select("row_key", *feats, "label"), "row_key", "label", feats, k=5, seed=seed)
        made = made.select(F.concat_ws("-", "row_key", "syn_idx").alias("row_key"), *feats, "label")
        return metrics.with_weights(made, "label", b.class_weights, "weight")

    def candidate(params: dict, make) -> tune.Candidate:
        return tune.estimator(params, make, "row_key", "label")

    def simple(params: dict, build) -> tune.Candidate:
        return candidate(params, lambda rows: models.pipeline(feats, build(**params)))

    edges = tune.SharedEdges()

    def grown(params: dict, build, weight: str | None = None) -> tune.Candidate:
        return tune.boosted(params, build(**params), feats, "row_key", "label", weight, edges)

    def nearest(rows: DataFrame, held: DataFrame) -> DataFrame:
        p = neighbors.knn_classify(rows, held, "row_key", "label", feats, **b.knn)
        return held.select("row_key", "label").join(p, "row_key")

    def kernel_machine(rows: DataFrame, held: DataFrame) -> DataFrame:
        constants = models.standard_constants(rows, feats)
        mapped = [cut_lineage(models.rff_vectors(x, feats, constants, n_components=b.svm["n_components"])) for x in (rows, held)]
        return models.score(models.linear_svc(b.svm["C"], mapped[0].count()).fit(mapped[0]), mapped[1], "row_key", "label")

    return tune.compare({
        "logistic": candidate(b.logistic, lambda rows: models.pipeline(feats, models.logistic(n=rows.count(), **b.logistic))),
        "tree": simple(b.tree, models.tree),
        "forest": simple(b.forest, models.forest),
        "knn": tune.Candidate(b.knn, nearest),
        "svm": tune.Candidate(b.svm, kernel_machine),
        "boosting": grown(b.boosting, lambda **o: models.levelwise(reg_lambda=0.0, min_child_weight=0.0, **o)),
        "xgb_style": grown(b.xgb_style, models.levelwise),
        "leafwise_style": grown(b.leafwise_style, models.leafwise),
        "weighted_style": grown(b.weighted_style, models.levelwise, "weight"),
    }, tr, te, "label", folds=b.folds, resample=oversampled)


def ensemble(spark, sf_dir, seed: int = 42, budget: EnsembleBudget | None = None) -> DataFrame:
    b = budget or EnsembleBudget()
    ch = _clean_churn(spark, sf_dir)
    u = hash_uniform(seed, "c_custkey")
    part = F.when(u < 0.2, "score").when(u < 0.36, "valid").otherwise("train")
    ch = _in_fewer(cut_lineage(ch.withColumn("part", part)))
    train, valid = ch.where(F.col("part") == "train"), ch.where(F.col("part") == "valid")
    unlabelled = ch.where(F.col("part") == "score").drop("exited")

    # branch A: encoded features, SMOTE, forest search with a constrained sweep
    prep = encode.fit_prep(train, label_cols=NOMINAL, scale_cols=FEATS)
    codes = encode.fit_minmax(prep.transform(train), NOMINAL)

    def encoded(rows):
        return codes.transform(prep.transform(rows))

    feats = FEATS + NOMINAL
    tr_a = resample.smote(encoded(train).select("c_custkey", *feats, "exited"), "c_custkey", "exited",
                          feats, k=5, seed=seed).withColumn("label", F.col("exited"))
    tr_a = _by_rows(metrics.with_weights(tr_a, "label", "balanced", "weight"))
    va_a = _by_rows(encoded(valid).withColumn("label", F.col("exited")))
    space = {"n_estimators": tune.Draw("int", *b.n_estimators), "max_depth": tune.Draw("int", *b.max_depth),
             "min_samples_leaf": tune.Draw("int", 1, 10),
             "max_features": tune.Draw("categorical", choices=("sqrt", "log2"))}

    def make(p):
        return models.pipeline(feats, models.forest(p["n_estimators"], p["max_depth"], p["min_samples_leaf"],
                                                    p["max_features"], weight_col="weight"))
    _, _, rf = tune.halving_search(make, space, b.trials, tr_a, va_a, "c_custkey", "label",
                                   tune.sweep_objective("f1", min_precision=0.5, min_recall=0.8), seed=seed, parallelism=8)

    # branch B: raw nominal columns, SMOTE-NC, nominal boosting with class weights
    scale = prep.scaler.transform            # the same train-fitted min-max constants
    tr_b = resample.smote(scale(train.select("c_custkey", *FEATS, *NOMINAL, "exited")),
                          "c_custkey", "exited", FEATS, k=5, seed=seed, nominal=NOMINAL)
    tr_b = _by_rows(metrics.with_weights(tr_b.withColumn("label", F.col("exited")), "label",
                                         {0: 0.32, 1: 0.68}, "weight"))
    gb = models.nominal_boosting_pipeline(FEATS, NOMINAL, weight_col="weight", max_levels=models.most_levels(tr_b, NOMINAL),
                                          **b.boosting).fit(tr_b)

    # validation grid over weights × thresholds, then the unlabelled set
    pa = models.score(rf, va_a, "c_custkey", "label").select("c_custkey", "label", F.col("p").alias("p_rf"))
    pb = models.score(gb, scale(valid), "c_custkey").select(
        "c_custkey", F.col("p").alias("p_gb"))
    both = cut_lineage(pa.join(pb, "c_custkey"))
    choice = metrics.best_ensemble(metrics.ensemble_grid(both, "p_rf", "p_gb", "label")).first()
    sa = models.score(rf, encoded(unlabelled), "c_custkey").select("c_custkey", "p")
    sb = models.score(gb, scale(unlabelled), "c_custkey").select("c_custkey", "p")
    final = metrics.ensemble_mean(sa, sb, "c_custkey", choice["w1"], choice["w2"], choice["threshold"])
    val_pred = (F.col("p_rf") * choice["w1"] + F.col("p_gb") * choice["w2"]) / (choice["w1"] + choice["w2"])
    hard = (val_pred >= choice["threshold"]).cast("int")
    report = metrics.prf(both, "label", hard)
    ranked = metrics.rank_metrics(both, hard, "label").first()
    scored = final.agg(F.count(F.lit(1)).alias("n_scored"), F.sum("pred").alias("n_flagged")).first()
    return report.select(F.lit(choice["w1"]).alias("w_rf"), F.lit(choice["w2"]).alias("w_gb"),
                         F.lit(choice["threshold"]).alias("threshold"), "accuracy", "precision", "recall", "f1",
                         F.lit(ranked["auc"]).alias("roc_auc"), F.lit(ranked["ap"]).alias("ap"),
                         F.lit(scored["n_scored"]).alias("n_scored"),
                         F.lit(scored["n_flagged"]).cast("bigint").alias("n_flagged"))


def segmentation(spark, sf_dir, seed: int = 42, budget: SegmentationBudget | None = None) -> DataFrame:
    """Long table (population, profile, cluster, item, value): the elbow's choice,
    churn rates (of all customers), means, modes, boxes, bars with intervals, and
    pair and 3-D counts over ten bins per feature."""
    b = budget or SegmentationBudget()
    ch = _clean_churn(spark, sf_dir)
    f = cut_lineage(encode.fit_minmax(ch, FEATS).transform(ch))
    imp = models.importances(models.pipeline(FEATS, models.forest(label="exited", **b.forest)).fit(f), FEATS)
    top3 = [r["feature"] for r in imp.limit(3).collect()]
    out = []
    for name, part, k in (("all", f, 4), ("churned", f.where(F.col("exited") == 1), 3)):
        chosen = segment.choose_k(segment.elbow_curve(part, top3, b.k_max, seed)).first()
        model, x = segment.fit_kmeans(part, top3, k, seed)
        fitted = cut_lineage(model.transform(x).select("c_custkey", *FEATS, "exited", "cluster"))

        def add(kind: str, rows: DataFrame, items: list[str], label=None, population: str = name) -> None:
            """Each column of ``items`` as a row of its own."""
            value = F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in items])).alias("v")
            item = F.concat_ws(":", *([label] if label is not None else []), F.col("v.item"))
            out.append(rows.select("*", value).select(F.lit(population).alias("population"), F.lit(kind).alias("profile"),
                                                      F.col("cluster").cast("int").alias("cluster"), item.alias("item"), F.col("v.value").alias("value")))

        add("elbow", spark.range(1).select(F.lit(None).cast("int").alias("cluster"), F.lit(chosen["k_steepest"]).alias("k_steepest"),
                                           F.lit(chosen["k_curvature"]).alias("k_curvature"), F.lit(k).alias("k_used")),
            ["k_steepest", "k_curvature", "k_used"])
        if name == "all":  # among churned customers the rate is 1 by construction
            add("rate", segment.cluster_rate(fitted, "cluster", "exited"), ["rate", "n"])
        add("mean", segment.cluster_means(fitted, "cluster", ("c_custkey",)), [*FEATS, "exited"])
        add("mode", segment.group_modes(fitted, "cluster", ["n_orders", "n_prio"]), ["n_orders", "n_prio"])
        add("box", profile.box_stats(fitted, "cluster", top3[0]), ["q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers"], F.lit(top3[0]))
        for c in top3[1:]:
            add("bar", profile.group_mean_ci(fitted, "cluster", c), ["mean", "ci_lo", "ci_hi"], F.lit(c))
        add("pair", profile.pair_bins(fitted, top3, hue="cluster"), ["n"], F.concat_ws(",", "x_col", "y_col", "x_bin", "y_bin"))
        tenths = fitted.select("cluster", *[F.least(F.floor(F.col(c) * 10), F.lit(9)).alias(c) for c in top3])
        add("points", profile.scatter3_counts(tenths, top3, "cluster"), ["n"], F.concat_ws(",", *top3))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


@query("comparison_pipeline", ops="entry 1: S1 C2 C4 E1 E2 E5 D1 R1 M1-M9 V2 V4 V5 V9 V10")
def comparison_pipeline(spark, sf_dir):
    return comparison(spark, sf_dir)


@query("ensemble_pipeline", ops="entry 2: S2 D1 E4 R1 R3 T2 T3 V6 M3 M7 P7 V8 M13")
def ensemble_pipeline(spark, sf_dir):
    return ensemble(spark, sf_dir)


@query("segmentation_pipeline", ops="entry 3: M12 V12 M10 A7 A8 A9 A12 A13 A14 A15")
def segmentation_pipeline(spark, sf_dir):
    return segmentation(spark, sf_dir)
