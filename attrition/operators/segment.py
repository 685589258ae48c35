"""Segmentation: k-means, elbow curves and per-cluster profiles (M10, V12,
W2, W3, J5, A7–A9, G1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.functions.hashing import hash_uniform
from attrition.session import cut_lineage

MAX_CENTRES = 10_000
#: Rows of a task in the passes of a fit, and tasks that a pass of MLlib's is left at least.
TASK_ROWS, LEAST_TASKS = 1 << 15, 8
SUM_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))


def assign_nearest(df: DataFrame, features: list[str], centres: list[list[float]],
                   out: str = "cluster") -> DataFrame:
    """Index of the nearest centre (squared euclidean, ties to the lower
    index).  The k centres live in the expression, so there is no join."""
    if len(centres) > MAX_CENTRES:
        raise ValueError("too many centres to inline")
    d2 = []
    for c in centres:
        terms = [(F.col(f).cast("double") - F.lit(float(v))) * (F.col(f).cast("double") - F.lit(float(v)))
                 for f, v in zip(features, c)]
        s = terms[0]
        for t in terms[1:]:
            s = s + t
        d2.append(s)
    pairs = F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(d2)])
    return df.withColumn(out, F.array_min(pairs)["i"])


def fit_kmeans(df: DataFrame, features: list[str], k: int, seed: int = 42, max_iter: int = 20):
    """MLlib k-means (k-means|| init).  Returns (model, assembled df).  A null
    or NaN feature is an error: clean or impute first."""
    va = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="error")
    x = va.transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster",
                   maxIter=max_iter).fit(x)
    return model, x


def total_ss(df: DataFrame, features: list[str]) -> float:
    """SSE of one cluster (k = 1): Σ_j n · var_pop(x_j)."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.var_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    return float(sum((row[f] or 0.0) * row["n"] for f in features))


def elbow_curve(df: DataFrame, features: list[str], k_max: int = 10, seed: int = 42,
                parallelism: int = 4) -> DataFrame:
    """SSE (inertia) for k = 1..k_max; one MLlib fit per k ≥ 2, fitted
    concurrently over a materialised copy of the input."""
    clean = cut_lineage(df.select(*features).na.drop())
    # every task of every pass reports to the driver: no more of them than the rows need
    clean = clean.coalesce(max(LEAST_TASKS, math.ceil(clean.count() / TASK_ROWS)))

    def sse(k: int) -> tuple[int, float]:
        if k == 1:
            return 1, total_ss(clean, features)
        model, _ = fit_kmeans(clean, features, k, seed)
        return k, float(model.summary.trainingCost)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = sorted(pool.map(sse, range(1, k_max + 1)))
    return df.sparkSession.createDataFrame(rows, "k int, sse double")


def kmeans_all_k(df: DataFrame, key, features: list[str], k_max: int = 10, seed: int = 42, max_iter: int = 300) -> tuple[DataFrame, dict[int, list[list[float]]]]:
    """M10 + V12: k-means for every k = 1..k_max at once.

    The first centres of k are the k rows with the smallest hash of the key (the same
    rows for all k).  One scan per iteration moves the centres of all k that still move; a task sends
    at most k_max · (k_max + 1) / 2 rows of sums.  A centre without rows stays where it is.  Ends when no centre
    moves.  Rows with a null feature are left out.  Returns (k, sse) and the centres."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = cut_lineage(df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).na.drop(subset=features))
    first = [[r[f] for f in features] for r in rows.orderBy(hash_uniform(seed, *keys), *keys).limit(k_max).collect()]
    ks = range(1, min(k_max, len(first)) + 1)
    if not first:
        return df.sparkSession.createDataFrame([], "k int, sse double"), {}
    rows = rows.coalesce(max(1, math.ceil(rows.count() / TASK_ROWS)))
    centres = {k: np.array(first[:k]) for k in ks}
    moving = set(ks)
    for _ in range(max_iter):
        sums = _centre_sums(rows, features, {k: centres[k] for k in moving}).collect()
        moving = set()
        for r in sums:
            new = np.array(r["sums"]) / r["n"]
            # the order in which tasks' sums arrive may change the last bits
            if not np.allclose(new, centres[r["k"]][r["i"]], rtol=1e-12, atol=0.0):
                moving.add(r["k"])
            centres[r["k"]][r["i"]] = new
        if not moving:
            break
    sse = _centre_sums(rows, features, centres).groupBy("k").agg(F.sum("sse").alias("sse"))
    return sse, {k: c.tolist() for k, c in centres.items()}


def _centre_sums(rows: DataFrame, features: list[str], centres: dict[int, np.ndarray]) -> DataFrame:
    """(k, i, n, sse, sums) of the rows nearest to centre i of k, the lowest index on
    ties.  Each task adds up its own rows first."""
    sum_types = SUM_TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros((len(c), 2 + len(features))) for k, c in centres.items()}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for k, c in centres.items():
                d2 = sum((x[:, f, None] - c[None, :, f]) ** 2 for f in range(x.shape[1]))
                near = d2.argmin(axis=1)
                for n, values in enumerate([None, d2[np.arange(len(x)), near], *x.T]):
                    totals[k][:, n] += np.bincount(near, values, minlength=len(c))
        flat = [(k, i, int(t[0]), float(t[1]), t[2:].tolist()) for k, table in totals.items() for i, t in enumerate(table) if t[0]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*flat, strict=True) if flat else [()] * 5, sum_types, strict=True)], names=["k", "i", "n", "sse", "sums"])

    made = rows.select(*features).mapInArrow(run, "k int, i int, n bigint, sse double, sums array<double>")
    sums = [F.sum(F.col("sums")[f]) for f in range(len(features))]
    return made.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.array(*sums).alias("sums"))


def choose_k(curve: DataFrame) -> DataFrame:
    """W2 + W3 over a (k, sse) curve.

    ``k_steepest``: the k (≥ 2) just before the steepest drop, i.e.
    argmin over k ≥ 2 of sse(k+1) − sse(k), first on ties.
    ``k_curvature``: argmax of the second difference, first on ties."""
    w = Window.orderBy("k")  # the curve has one row per k (tens of rows)
    c = (curve.withColumn("next_drop", F.lead("sse").over(w) - F.col("sse"))
         .withColumn("curv", F.lag("sse").over(w) - 2 * F.col("sse") + F.lead("sse").over(w)))
    return c.agg(
        F.min_by("k", F.when((F.col("k") >= 2) & F.col("next_drop").isNotNull(),
                             F.struct("next_drop", "k"))).alias("k_steepest"),
        F.min_by("k", F.when(F.col("curv").isNotNull(),
                             F.struct((-F.col("curv")).alias("nc"), "k"))).alias("k_curvature"))


def binned_sse_curve(df: DataFrame, col: str, k_max: int = 10) -> DataFrame:
    """A deterministic SSE-by-k curve: within-bin sum of squares of ``col``
    cut into k equal-width bins, k = 1..k_max, in one pass (rows × k_max
    partial sums)."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).select(F.struct("mn", "mx")).scalar()
    mn, mx = rng["mn"], rng["mx"]
    k, xs = F.col("k"), F.col("x")
    b = F.when(mx == mn, F.lit(0)).otherwise(F.least(F.floor((xs - mn) * k / (mx - mn)), k - 1))
    per_bin = (df.where(x.isNotNull())
               .select(x.alias("x"), F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"))
               .withColumn("b", b)
               .groupBy("k", "b").agg((F.var_pop("x") * F.count(F.lit(1))).alias("ss")))
    return per_bin.groupBy("k").agg(F.sum("ss").alias("sse"))


def cluster_rate(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Mean label (churn rate) per cluster."""
    return df.groupBy(cluster).agg(F.avg(F.col(label)).alias("rate"), F.count(F.lit(1)).alias("n"))


def cluster_means(df: DataFrame, cluster: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every numeric column per cluster, id columns excluded."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
            and f.name not in exclude and f.name != cluster]
    return df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in nums])


def group_modes(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Most frequent value per group and column, smallest on ties.

    Counts per (group, column, value) are combined map-side; the choice is
    a ``min_by`` over those counts, so no group's rows are ever collected."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [group], cols, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy(group, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(group, "column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("mode"))
    return best.groupBy(group).pivot("column", cols).agg(F.first("mode"))
