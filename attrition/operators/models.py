"""Classifiers fitted with MLlib.

The reference's models come from several single-machine libraries; each is
re-expressed as an MLlib estimator with its hyper-parameters translated:

* logistic ``C``            → ``regParam = 1 / (C · n)``, no elastic net, no
  standardisation (same objective up to the scale of the loss);
* tree / forest depth       → ``maxDepth`` (MLlib caps it at 30);
* ``min_samples_leaf``      → ``minInstancesPerNode``;
* ``max_features``          → ``featureSubsetStrategy`` (``sqrt``, ``log2``, a fraction);
* class weights / ``scale_pos_weight`` → a ``weightCol`` (P7);
* leaf-wise boosting with L1 and L2 terms → :mod:`boost`;
* forests of large tables → :mod:`forest` (same settings, own draws);
* nominal columns in boosting → ``StringIndexer`` + categorical splits;
* kernel SVM                → random Fourier features (rbf) or a polynomial
  expansion feeding ``LinearSVC``.

Everything is fitted and scored on executors; the driver only sees model
parameters and metric rows.  The trees of MLlib's own models are among these.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.operators import boost, nominal
from attrition.operators import forest as forests
from attrition.session import cut_lineage

MAX_DEPTH = 30
#: Sums of split candidates that a pass over the rows may collect in a task.
FOREST_MB = 1024
#: Training rows up to which MLlib grows a forest; its nodes are objects on the driver.
MLLIB_FOREST_ROWS = 1 << 12
#: Training rows up to which MLlib fits nominal boosting, a job a level.
MLLIB_BOOSTING_ROWS = 1 << 15


def checked_depth(depth: int) -> int:
    """MLlib builds trees of at most 30 levels; a deeper request is an error
    rather than another model."""
    if depth > MAX_DEPTH:
        raise ValueError(f"max_depth {depth} exceeds the {MAX_DEPTH} levels that MLlib builds")
    return depth


def assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def logistic(C: float = 1.0, n: int = 1, max_iter: int = 1000, weight_col: str | None = None,
             label: str = "label") -> LogisticRegression:
    """M1."""
    lr = LogisticRegression(regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0, standardization=False,
                            maxIter=max_iter, labelCol=label, featuresCol="features")
    if weight_col:
        lr.setWeightCol(weight_col)
    return lr


def tree(max_depth: int = 5, min_samples_leaf: int = 1, max_features: str | None = None,
         weight_col: str | None = None, label: str = "label", seed: int = 42):
    """M2: a single CART tree; with ``max_features`` a one-tree forest
    without bootstrap (feature subsampling per split)."""
    depth = checked_depth(max_depth)
    if max_features:
        est = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=max_features,
                                     maxDepth=depth, minInstancesPerNode=min_samples_leaf,
                                     impurity="gini", seed=seed, labelCol=label)
    else:
        est = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_samples_leaf,
                                     impurity="gini", seed=seed, labelCol=label)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


class ForestClassifier(RandomForestClassifier):
    """MLlib's forest for small tables; beyond ``MLLIB_FOREST_ROWS`` rows :mod:`forest` grows it,
    with the same settings and draws of its own."""

    def _fit(self, dataset: DataFrame):
        n = self._grown_rows(dataset)
        return super()._fit(dataset) if n is None else self.fit_together([self], dataset, n)[0]

    def _grown_rows(self, dataset: DataFrame) -> int | None:
        """The rows' number where :mod:`forest` grows the trees."""
        sound = F.col(self.getLabelCol()).cast("double").isin(0.0, 1.0)
        if self._weight():
            sound &= F.col(self._weight()).cast("double").between(0.0, 1e300)
        n, sound = dataset.agg(F.count(F.lit(1)), F.min(F.coalesce(sound, F.lit(False)))).first()
        # other classes are MLlib's too; it refuses null labels and bad weights
        return n if n > MLLIB_FOREST_ROWS and sound else None

    def _weight(self) -> str | None:
        return self.getWeightCol() if self.isSet(self.weightCol) else None

    @staticmethod
    def fit_together(forests_: list[ForestClassifier], dataset: DataFrame, n: int) -> list[GrownForest]:
        """Forests that differ in their trees' number, depth, least rows and features alone.  Those of
        the same least rows and features are read from the largest."""
        one = forests_[0]
        rows, n_feats = feature_arrays(dataset, one.getFeaturesCol())
        kinds: dict[tuple, list[tuple[int, int]]] = {}
        own = [(f.getMinInstancesPerNode(), forests.subset_size(f.getFeatureSubsetStrategy(), n_feats), f.getSeed()) for f in forests_]
        for f, kind in zip(forests_, own, strict=True):
            kinds.setdefault(kind, []).append((f.getNumTrees(), f.getMaxDepth()))
        ps = [forests.Forest(max(t for t, _ in sizes), max(d for _, d in sizes), *kind) for kind, sizes in kinds.items()]
        grown = forests.fit_many(rows, "__x", n_feats, one.getLabelCol(), one._weight(), ps, n, [tuple(d for _, d in sizes) for sizes in kinds.values()])
        by_kind = dict(zip(kinds, grown, strict=True))
        return [GrownForest(by_kind[kind], one.getFeaturesCol(), (f.getNumTrees(), f.getMaxDepth())) for f, kind in zip(forests_, own, strict=True)]


def fit_all(estimators: list, train: DataFrame) -> list[PipelineModel] | None:
    """The models of forests that :mod:`forest` grows and that share their trees; None for others,
    which are better fitted and scored one after the other than held all at once."""
    last = [e.getStages()[-1] if isinstance(e, Pipeline) else None for e in estimators]
    alike = {_without_sizes(e) if isinstance(f, ForestClassifier) else None for e, f in zip(estimators, last, strict=True)}
    if len(alike) != 1 or None in alike:
        return None
    before = estimators[0].getStages()[:-1]
    rows = PipelineModel(before).transform(train)
    n = last[0]._grown_rows(rows)
    return None if n is None else [PipelineModel([*before, m]) for m in ForestClassifier.fit_together(last, rows, n)]


def _without_sizes(pipe: Pipeline) -> str | None:
    """All settings of an assembler and a forest but those that may differ in :meth:`ForestClassifier.fit_together`."""
    if not all(isinstance(s, Transformer) for s in pipe.getStages()[:-1]):
        return None
    free = {"numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy"}
    return repr([(type(s), sorted((p.name, str(v)) for p, v in s.extractParamMap().items() if p.name not in free)) for s in pipe.getStages()])


class GrownForest(Model):
    """A forest of :mod:`forest`, or its first trees cut at a depth, with the output columns of MLlib's."""

    def __init__(self, grown: forests.Grown, features: str, size: tuple[int, int] | None = None) -> None:
        super().__init__()
        self.grown, self.features = grown, features
        self.size = size or (grown.p.trees, grown.p.max_depth)

    @property
    def getNumTrees(self) -> int:
        return self.size[0]

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.grown.importances_of(*self.size))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = cut_lineage(dataset.withColumn("__row", F.monotonically_increasing_id()))
        p = forests.score(self.grown, feature_arrays(rows, self.features)[0], "__row", "__x", [self.size]).drop("variant")
        trees = float(self.size[0])
        out = rows.join(p.withColumnRenamed("p", "__p"), "__row")
        both = F.array(1.0 - F.col("__p"), F.col("__p"))
        return (out.withColumn("rawPrediction", array_to_vector(F.transform(both, lambda v: v * trees)))
                .withColumn("probability", array_to_vector(both)).withColumn("prediction", (F.col("__p") > 0.5).cast("double")).drop("__row", "__p"))


def feature_arrays(df: DataFrame, features: str) -> tuple[DataFrame, int]:
    """The vector column as the array ``__x``, and its length."""
    size = df.schema[features].metadata.get("ml_attr", {}).get("num_attrs")
    df = df.withColumn("__x", vector_to_array(features))
    return df, int(size if size is not None else df.select(F.size("__x")).first()[0])


def forest(n_estimators: int = 100, max_depth: int = 10, min_samples_leaf: int = 1,
           max_features: str = "sqrt", weight_col: str | None = None, label: str = "label",
           seed: int = 42) -> RandomForestClassifier:
    """M3."""
    # deep trees: more nodes a pass, and rows that know their node
    est = ForestClassifier(numTrees=n_estimators, maxDepth=checked_depth(max_depth),
                           minInstancesPerNode=min_samples_leaf, maxMemoryInMB=FOREST_MB,
                           featureSubsetStrategy=str(max_features), seed=seed, labelCol=label)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def boosting(n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
             min_samples_leaf: int = 1, subsample: float = 1.0, max_features: str = "all",
             weight_col: str | None = None, label: str = "label", seed: int = 42,
             max_bins: int = 32) -> GBTClassifier:
    """M4 (and the base of M5–M7)."""
    est = GBTClassifier(maxIter=n_estimators, stepSize=learning_rate, maxDepth=checked_depth(max_depth),
                        minInstancesPerNode=min_samples_leaf, subsamplingRate=subsample,
                        featureSubsetStrategy=str(max_features), seed=seed, labelCol=label,
                        maxBins=max_bins)
    if weight_col:
        est.setWeightCol(weight_col)
    return est


def boosting_xgb_style(n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 6,
                       subsample: float = 1.0, colsample_bytree: float = 1.0,
                       weight_col: str | None = None, **kw) -> GBTClassifier:
    """M5: ``colsample_bytree`` → fraction subset strategy; the positive
    class weight (``scale_pos_weight``) arrives as ``weight_col``."""
    frac = "all" if colsample_bytree >= 1.0 else str(colsample_bytree)
    return boosting(n_estimators, learning_rate, max_depth, 1, subsample, frac, weight_col, **kw)


def leafwise(n_estimators: int = 100, learning_rate: float = 0.1, num_leaves: int = 31, max_depth: int = 0,
             min_child_samples: int = 20, min_child_weight: float = 1e-3, reg_alpha: float = 0.0, reg_lambda: float = 0.0,
             subsample: float = 1.0, colsample_bytree: float = 1.0, seed: int = 42) -> boost.Boosting:
    """M6: best-first trees with L1 and L2 terms (:mod:`boost`)."""
    return boost.Boosting(n_estimators, learning_rate, num_leaves, max_depth, min_child_samples, min_child_weight, reg_alpha, reg_lambda,
                          subsample, colsample_bytree, seed=seed)


def levelwise(n_estimators: int = 100, learning_rate: float = 0.3, max_depth: int = 6, reg_alpha: float = 0.0, reg_lambda: float = 1.0,
              min_child_weight: float = 1.0, subsample: float = 1.0, colsample_bytree: float = 1.0, seed: int = 42) -> boost.Boosting:
    """M4, M5, M7 on numbers: all leaves of a level are split, L2 term ``reg_lambda``."""
    return boost.Boosting.level_wise(max_depth, rounds=n_estimators, learning_rate=learning_rate, min_child_weight=min_child_weight, reg_alpha=reg_alpha,
                                     reg_lambda=reg_lambda, subsample=subsample, colsample=colsample_bytree, seed=seed)


class NominalBoosting(GBTClassifier):
    """MLlib's boosting for small tables; beyond ``MLLIB_BOOSTING_ROWS`` rows :mod:`nominal` runs the same rounds
    over the distinct rows of bins (bins cut at the rows' own quantiles, not at a sample's)."""

    def _fit(self, dataset: DataFrame):
        weight = self.getWeightCol() if self.isSet(self.weightCol) else None
        sound = F.col(self.getLabelCol()).cast("double").isin(0.0, 1.0)
        if weight:
            sound &= F.col(weight).cast("double").between(0.0, 1e300)
        rows, n_feats = feature_arrays(dataset, self.getFeaturesCol())
        sound &= F.forall("__x", lambda v: F.abs(v) < math.inf)       # MLlib refuses others; NaN counts as greater
        n, sound = rows.agg(F.count(F.lit(1)), F.min(F.coalesce(sound, F.lit(False)))).first()
        levels = [0] * n_feats
        attrs = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        for a in attrs.get("nominal", []):
            levels[a["idx"]] = len(a["vals"]) if "vals" in a else int(a.get("num_vals", 0))
        if n > MLLIB_BOOSTING_ROWS and sound and max(levels) <= 255:
            p = nominal.Settings(self.getMaxIter(), self.getStepSize(), self.getMaxDepth(), self.getMinInstancesPerNode())
            made = nominal.fit(rows, "__x", levels, self.getLabelCol(), weight, p, min(self.getMaxBins(), 255))
            if made is not None:
                return BoostedModel(made, self.getFeaturesCol())
        return super()._fit(dataset)


class BoostedModel(Model):
    """A model of :mod:`nominal` with the output columns of MLlib's."""

    def __init__(self, made: nominal.Boosted, features: str) -> None:
        super().__init__()
        self.made, self.features = made, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = nominal.score(self.made, feature_arrays(dataset, self.features)[0], "__x", "__m")
        p = 1.0 / (1.0 + F.exp(-2.0 * F.col("__m")))
        return (out.withColumn("rawPrediction", array_to_vector(F.array(-F.col("__m"), F.col("__m")))).withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
                .withColumn("prediction", (F.col("__m") > 0).cast("double")).drop("__x", "__m"))


def nominal_boosting_pipeline(numeric: list[str], nominal: list[str], n_estimators: int = 100,
                              learning_rate: float = 0.03, depth: int = 6, weight_col: str | None = None,
                              label: str = "label", seed: int = 42, max_levels: int = 63) -> Pipeline:
    """M7: boosting directly on nominal columns: string indexes enter the
    vector as categorical features (``VectorAssembler`` keeps the nominal
    attribute metadata), so trees split on category sets.  ``max_levels`` is
    the largest number of levels (:func:`most_levels` of the training rows)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep") for c in nominal]
    va = assembler(list(numeric) + [f"{c}__idx" for c in nominal])
    gbt = NominalBoosting(maxIter=n_estimators, stepSize=learning_rate, maxDepth=checked_depth(depth), minInstancesPerNode=1, subsamplingRate=1.0,
                          featureSubsetStrategy="all", seed=seed, labelCol=label, maxBins=max(32, max_levels + 1))
    if weight_col:
        gbt.setWeightCol(weight_col)
    return Pipeline(stages=[*idx, va, gbt])


def most_levels(df: DataFrame, nominal: list[str]) -> int:
    """The largest number of distinct values among nominal columns."""
    row = df.agg(*[F.count_distinct(F.col(c)) for c in nominal]).first()
    return max([*row, 1])


def linear_svc(C: float = 1.0, n: int = 1, label: str = "label", max_iter: int = 50) -> LinearSVC:
    """M8 (linear kernel)."""
    return LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=max_iter, labelCol=label, standardization=False)


def standard_constants(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature, fitted on ``df``
    (a constant feature gets deviation 1)."""
    row = df.agg(*[e for f in features for e in (F.avg(F.col(f).cast("double")), F.stddev_pop(F.col(f).cast("double")))]).first()
    return {f: (row[2 * i] or 0.0, row[2 * i + 1] or 1.0) for i, f in enumerate(features)}


def standardised(features: list[str], constants: dict[str, tuple[float, float]]) -> SQLTransformer:
    """Stage that adds each feature, standardised, as ``__z_<feature>``."""
    cols = [f"(CAST(`{f}` AS DOUBLE) - ({constants[f][0]!r}D)) / {constants[f][1]!r}D AS `__z_{f}`" for f in features]
    return SQLTransformer(statement=f"SELECT *, {', '.join(cols)} FROM __THIS__")


def rff_stage(features: list[str], gamma: float, n_components: int = 100, seed: int = 42,
              out: str = "features") -> Transformer:
    """Random Fourier features for an rbf kernel exp(-γ‖x−y‖²) (Rahimi &
    Recht 2007): z_j = sqrt(2/D) cos(w_j·x + b_j), w ~ N(0, 2γ I),
    b ~ U[0, 2π).  A column-expression stage: no Python per row."""
    rng = random.Random(seed)
    sd = math.sqrt(2.0 * gamma)
    comps = []
    for j in range(n_components):
        w = [rng.gauss(0.0, sd) for _ in features]
        b = rng.uniform(0.0, 2 * math.pi)
        lin = " + ".join(f"({wi!r}D * CAST(`{f}` AS DOUBLE))" for wi, f in zip(w, features))
        comps.append(f"{math.sqrt(2.0 / n_components)!r}D * cos({lin} + {b!r}D) AS `__rff{j}`")
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, {', '.join(comps)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__rff{j}" for j in range(n_components)], outputCol=out)])


def rff_vectors(df: DataFrame, features: list[str], scaling: dict[str, tuple[float, float]], gamma: float | None = None,
                n_components: int = 100, seed: int = 42, out: str = "features") -> DataFrame:
    """The columns of :func:`rff_stage` over standardised features as one vector column,
    computed in Arrow batches: a hundred cosines of all features are too much for one
    generated method."""
    rng = random.Random(seed)
    sd = math.sqrt(2.0 * (gamma if gamma else 1.0 / len(features)))
    draws = [([rng.gauss(0.0, sd) for _ in features], rng.uniform(0.0, 2 * math.pi)) for _ in range(n_components)]
    weights, shift = np.array([w for w, _ in draws]).T, np.array([b for _, b in draws])

    @F.pandas_udf("array<double>")
    def cosines(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(math.sqrt(2.0 / n_components) * np.cos(np.stack(x.to_list()) @ weights + shift)))

    scaled = F.array(*[(F.col(f).cast("double") - scaling[f][0]) / scaling[f][1] for f in features])
    return df.withColumn(out, array_to_vector(cosines(scaled)))


def svc_pipeline(features: list[str], kernel: str = "rbf", C: float = 1.0, n: int = 1,
                 gamma: float | None = None, degree: int = 3, label: str = "label",
                 n_components: int = 100, seed: int = 42,
                 scaling: dict[str, tuple[float, float]] | None = None) -> Pipeline:
    """M8: linear, rbf (random features) or polynomial kernel + LinearSVC.
    ``scaling`` (:func:`standard_constants` of the training rows) standardises the
    features first; ``gamma`` then refers to them, and its default 1 / features
    is what ``gamma='scale'`` gives on standardised features."""
    stages = []
    if scaling is not None:
        stages, features = [standardised(features, scaling)], [f"__z_{f}" for f in features]
    if kernel == "linear":
        stages += [assembler(features)]
    elif kernel == "rbf":
        stages += [rff_stage(features, gamma if gamma else 1.0 / len(features), n_components, seed)]
    elif kernel == "poly":
        stages += [assembler(features, "__raw"),
                  PolynomialExpansion(degree=degree, inputCol="__raw", outputCol="features")]
    else:
        raise ValueError(f"unsupported kernel {kernel!r}")
    return Pipeline(stages=[*stages, linear_svc(C, n, label)])


def pipeline(features: list[str], estimator) -> Pipeline:
    return Pipeline(stages=[assembler(features), estimator])


def score(model: PipelineModel, df: DataFrame, key, label: str | None = None) -> DataFrame:
    """Key, (label), positive-class score ``p`` and hard label ``pred``.
    For margin classifiers (SVC) ``p`` is the logistic of the margin."""
    keys = [key] if isinstance(key, str) else list(key)
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1.0 / (1.0 + F.exp(-vector_to_array("rawPrediction")[1]))
    cols = [*keys] + ([label] if label else [])
    return out.select(*cols, p.alias("p"), F.col("prediction").cast("int").alias("pred"))


def score_all(fitted: list[PipelineModel], df: DataFrame, key, label: str | None = None, parallelism: int = 4) -> list[DataFrame]:
    """:func:`score` by each of the models of :func:`fit_all`; forests read from shared trees score
    the rows in one pass over these, and the scores are stored."""
    last = [m.stages[-1] for m in fitted]
    cols = ([key] if isinstance(key, str) else list(key)) + ([label] if label else [])
    rows = PipelineModel(fitted[0].stages[:-1]).transform(df).select(*cols, last[0].features, F.monotonically_increasing_id().alias("__row"))
    rows = cut_lineage(rows)
    n = rows.count()
    rows = rows.coalesce(max(1, n // forests.HELD_ROWS))
    by_forest: dict[int, list[GrownForest]] = {}
    for m in last:
        by_forest.setdefault(id(m.grown), []).append(m)
    sizes = {g: sorted({m.size for m in own}) for g, own in by_forest.items()}
    arrays, known = feature_arrays(rows, last[0].features)[0], rows.drop(last[0].features)

    def one(g: int) -> DataFrame:
        scored = cut_lineage(known.join(forests.score(by_forest[g][0].grown, arrays, "__row", "__x", sizes[g]), "__row"))
        return scored.coalesce(max(1, n * len(sizes[g]) // forests.HELD_ROWS))

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        stored = dict(zip(by_forest, pool.map(one, by_forest), strict=True))
    return [stored[id(m.grown)].where(F.col("variant") == sizes[id(m.grown)].index(m.size)).select(*cols, "p", (F.col("p") > 0.5).cast("int").alias("pred"))
            for m in last]


def importances(model, names: list[str]) -> DataFrame:
    """Feature importances by name, sorted (O1)."""
    tree_model = model.stages[-1] if isinstance(model, PipelineModel) else model
    vals = tree_model.featureImportances.toArray().tolist()
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature")
