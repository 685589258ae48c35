"""Exact classification trees (M2, M3) and their exact attributions.

Trees grow level by level, all trees of a forest and all nodes of a level in the
same jobs.  A level is one aggregation to class counts per (tree, node, feature,
value), so every distinct value of a feature is a candidate; there are no bins.
The counts are put in order by range partitions, and running counts come from
partition totals plus a window inside each partition, so no task holds a whole
feature.  Splits stay in tables: rows meet theirs by a join on (tree, node).

A node splits where the weighted Gini impurity falls most (ties: first feature,
smallest value); counts are whole numbers, so gains don't depend on the order of
rows.  Nodes are numbered 1 (root), 2n and 2n + 1.  A bootstrap takes a row
Poisson(1) times, from its key's hash; ``max_features`` are drawn per node.

Defined results: rows without a label don't train; a null value is smaller than
all others, NaN greater; a table without rows gives no nodes and null scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform
from attrition.operators.profile import POISSON_CDF
from attrition.session import cut_lineage, ship_package

#: Attributions read all leaves in every task; beyond this depth sample instead.
MAX_PATH_DEPTH = 12


@dataclass(frozen=True)
class Cart:
    max_depth: int = 5
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    class_weight: tuple[float, float] = (1.0, 1.0)
    trees: int = 1
    bootstrap: bool = False
    seed: int = 42


def _vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("-inf"))) for c in features]).alias("x")


def _drawn(p: Cart, node: Column, d: int) -> Column:
    """Numbers of the features that a node may split on."""
    ranked = F.array(*[F.struct(hash_uniform(p.seed, F.col("tree"), node, i).alias("u"), F.lit(i).alias("f")) for i in range(d)])
    return F.slice(F.array_sort(ranked), 1, min(p.max_features or d, d)).getField("f")


def impurity(p: Cart, n: Column, n1: Column) -> Column:
    """Weighted Gini impurity times the weight."""
    a, b = (n - n1) * F.lit(float(p.class_weight[0])), n1 * F.lit(float(p.class_weight[1]))
    return 2 * a * b / (a + b)


def _best(stats: DataFrame, p: Cart) -> DataFrame:
    """The split of each node, from counts per (tree, node, f, v)."""
    by = ["tree", "node", "f"]
    placed = cut_lineage(stats.repartitionByRange(*by, "v").withColumn("pid", F.spark_partition_id()))
    parts = placed.groupBy("pid", *by).agg(F.sum("n").alias("pn"), F.sum("n1").alias("pn1"))
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pid", *by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("pn", "pn1")],
                         F.sum("pn").over(whole).alias("total"), F.sum("pn1").over(whole).alias("total1"))
    here = Window.partitionBy("pid", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    runs = (placed.join(parts, ["pid", *by])
            .select(*by, "v", "total", "total1", (F.sum("n").over(here) + F.col("pn_before")).alias("n_left"),
                    (F.sum("n1").over(here) + F.col("pn1_before")).alias("n1_left")))
    n, n1, nl, n1l = (F.col(c) for c in ("total", "total1", "n_left", "n1_left"))
    gain = impurity(p, n, n1) - impurity(p, nl, n1l) - impurity(p, n - nl, n1 - n1l)
    best = (runs.where((n >= p.min_samples_split) & (n1 > 0) & (n1 < n))
            .where((nl >= p.min_samples_leaf) & (n - nl >= max(p.min_samples_leaf, 1)))
            .groupBy("tree", "node")
            .agg(F.min(F.struct((-F.round(gain, 9)).alias("cost"), "f", "v", gain.alias("gain"), n.alias("n"), n1.alias("n1"), "n_left", "n1_left")).alias("b"))
            .select("tree", "node", "b.*"))
    best = cut_lineage(best)
    above = placed.alias("s").join(best.alias("b"), by).where("s.v > b.v").groupBy("tree", "node").agg(F.min("s.v").alias("above"))
    mid = F.col("v") + (F.col("above") - F.col("v")) / 2
    threshold = F.when(F.isnan(mid) | (mid == F.col("above")) | (F.col("v") == float("-inf")), F.col("v")).otherwise(mid)
    return cut_lineage(best.join(above, ["tree", "node"]).select(
        "tree", "node", "f", F.col("v").alias("below"), threshold.alias("threshold"), "gain", "n", "n1", "n_left", "n1_left"))


def fit(df: DataFrame, key: str, features: list[str], label: str, p: Cart) -> tuple[DataFrame, DataFrame]:
    """(splits, nodes).  Splits: (tree, node, f, below, threshold, gain, n, n1, n_left,
    n1_left), ``f`` the feature's place in ``features``; nodes: (tree, node, n, n1)."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), _vector(features), F.col(label).cast("int").alias("y"))
    if p.trees > 1 or p.bootstrap:
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))))
    else:
        rows = rows.withColumn("tree", F.lit(0))
    times = F.lit(1)
    if p.bootstrap:
        u = hash_uniform(p.seed, F.col("key"), F.col("tree"), F.lit("bag"))
        times = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON_CDF), F.lit(0))
    rows = rows.withColumn("m", times.cast("long")).where("m > 0").select("tree", F.lit(1).cast("long").alias("node"), "x", "y", "m")
    rows = cut_lineage(rows)
    roots = cut_lineage(rows.groupBy("tree", "node").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("y")).alias("n1")))
    splits: list[DataFrame] = []
    d = len(features)
    front = roots.withColumn("drawn", _drawn(p, F.col("node"), d)).select("tree", "node", "drawn")
    for level in range(p.max_depth):
        counted = rows.join(front, ["tree", "node"]).select("tree", "node", "x", "y", "m", F.explode("drawn").alias("f"))
        stats = (counted.select("tree", "node", "f", F.get("x", F.col("f")).alias("v"), "y", "m").groupBy("tree", "node", "f", "v")
                 .agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("y")).alias("n1")))
        found = _best(stats, p)
        if found.isEmpty():
            break
        splits.append(found)
        # rows of leaves leave; the others go to a child
        rows = rows.join(found.select("tree", "node", "f", "below"), ["tree", "node"]).select(
            "tree", (2 * F.col("node") + F.when(F.get("x", F.col("f")) <= F.col("below"), 0).otherwise(1)).alias("node"), "x", "y", "m")
        child = found.select("tree", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
        front = child.withColumn("drawn", _drawn(p, F.col("node"), d))
    if not splits:
        none = "tree int, node long, f int, below double, threshold double, gain double, n long, n1 long, n_left long, n1_left long"
        return df.sparkSession.createDataFrame([], none), roots
    table = reduce(DataFrame.unionByName, splits)
    children = table.select("tree", F.explode(F.array(
        F.struct((2 * F.col("node")).alias("node"), F.col("n_left").alias("n"), F.col("n1_left").alias("n1")),
        F.struct((2 * F.col("node") + 1).alias("node"), (F.col("n") - F.col("n_left")).alias("n"), (F.col("n1") - F.col("n1_left")).alias("n1")))).alias("c"))
    return table, roots.unionByName(children.select("tree", "c.*"))


def _share(p: Cart) -> Column:
    a, b = (F.col("n") - F.col("n1")) * F.lit(float(p.class_weight[0])), F.col("n1") * F.lit(float(p.class_weight[1]))
    return b / (a + b)


def score(df: DataFrame, features: list[str], model: tuple[DataFrame, DataFrame], p: Cart, out: str = "prob") -> DataFrame:
    """``df`` with the mean share of class 1 over the trees' leaves."""
    splits, nodes = model
    cols = [F.col(f"`{c}`") for c in df.columns]
    # as many steps as the deepest split, not as the parameter allows
    deepest = splits.agg(F.max("node")).first()[0] or 0
    walk = df.select(F.struct(*cols).alias("row"), _vector(features), F.monotonically_increasing_id().alias("id") if p.trees > 1 else F.lit(0).alias("id"))
    walk = cut_lineage(walk) if p.trees > 1 else walk
    walk = walk.withColumn("node", F.lit(1).cast("long"))
    # also where there is one tree: a constant would leave the joins nothing to hash by
    walk = walk.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(p.trees - 1))))
    way = splits.select("tree", "node", "f", "threshold")
    for _ in range(int(deepest).bit_length()):
        side = F.when(F.get("x", F.col("f")) <= F.col("threshold"), 0).otherwise(1)
        walk = walk.join(way, ["tree", "node"], "left").select(
            "row", "x", "id", "tree", F.when(F.col("f").isNull(), F.col("node")).otherwise(2 * F.col("node") + side).alias("node"))
    walk = walk.join(nodes.select("tree", "node", _share(p).alias("share")), ["tree", "node"], "left")
    if p.trees > 1:
        walk = walk.groupBy("id").agg(F.first("row").alias("row"), F.avg("share").alias("share"))
    return walk.select("row.*", F.col("share").alias(out))


def importances(model: tuple[DataFrame, DataFrame], features: list[str]) -> DataFrame:
    """(feature, importance): each feature's share of the impurity taken away."""
    names = F.array(*[F.lit(c) for c in features])
    total = Window.partitionBy()
    gains = model[0].groupBy(F.get(names, F.col("f")).alias("feature")).agg(F.sum("gain").alias("gain"))
    return gains.select("feature", (F.col("gain") / F.sum("gain").over(total)).alias("importance"))


def paths(model: tuple[DataFrame, DataFrame], features: list[str], p: Cart) -> DataFrame:
    """(tree, leaf, value, share, x): a row per leaf; ``x`` has per feature the interval
    (low, high] of its conditions (null: no bound) and ``cover``, the share of training rows (by weight)
    that its splits on this path let through."""
    splits, nodes = model

    def weight(n: str, n1: str) -> Column:
        return (F.col(n) - F.col(n1)) * float(p.class_weight[0]) + F.col(n1) * float(p.class_weight[1])

    steps = splits.select("tree", "node", "f", "threshold", weight("n", "n1").alias("w"), weight("n_left", "n1_left").alias("wl"))
    full = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("cover"))
    at = nodes.where("node = 1").select("tree", "node", F.array(*[full for _ in features]).alias("x"))
    done = []
    for _ in range(p.max_depth + 1):
        step = cut_lineage(at.join(steps, ["tree", "node"], "left"))
        done.append(step.where("f IS NULL").select("tree", "node", "x"))

        def narrowed(left: bool) -> Column:
            def one(e: Column, i: Column) -> Column:
                part = F.col("wl") if left else F.col("w") - F.col("wl")
                cut = F.struct((e["low"] if left else F.greatest(e["low"], F.col("threshold"))).alias("low"),
                               (F.least(e["high"], F.col("threshold")) if left else e["high"]).alias("high"),
                               (e["cover"] * part / F.col("w")).alias("cover"))
                return F.when(i == F.col("f"), cut).otherwise(e)
            return F.transform("x", one)
        at = step.where("f IS NOT NULL").select("tree", F.explode(F.array(
            F.struct((2 * F.col("node")).alias("node"), narrowed(True).alias("x")),
            F.struct((2 * F.col("node") + 1).alias("node"), narrowed(False).alias("x")))).alias("c")).select("tree", "c.*")
    leaves = reduce(DataFrame.unionByName, done)
    return leaves.join(nodes.select("tree", "node", _share(p).alias("value")), ["tree", "node"]).select("tree", F.col("node").alias("leaf"), "value", "x")


def tree_attribution(df: DataFrame, key: str, features: list[str], model: tuple[DataFrame, DataFrame], p: Cart) -> DataFrame:
    """Exact Shapley values of a tree or forest score, (key, feature, value,
    attribution, base).  A coalition's worth is the score expected when splits on
    features outside it send rows both ways by training weight; a row's attributions
    add up to its score less ``base``.

    A leaf's share in feature i is value · (o_i − z_i) · ∫₀¹ Π_{j≠i} (z_j + t (o_j − z_j)) dt,
    o = 1 where the row meets the path's conditions on a feature, z their cover; the
    integral of this polynomial is exact by Gauss-Legendre points.  At most
    trees · 2^max_depth leaves reach the tasks (``max_depth`` ≤ ``MAX_PATH_DEPTH``)."""
    if p.max_depth > MAX_PATH_DEPTH:
        raise ValueError(f"exact attributions take trees of at most {MAX_PATH_DEPTH} levels")
    d = len(features)
    leaves = [(r["value"], [tuple(e) for e in r["x"]]) for r in paths(model, features, p).collect()]
    at, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    at, weights = (at + 1) / 2, weights / 2
    base = sum(v * np.prod([c for _, _, c in box]) for v, box in leaves) / p.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)
            phi = np.zeros_like(x)
            for value, box in leaves:
                low, high, z = (np.array(c, float) for c in zip(*box, strict=True))
                # a bound that is none became NaN; a value of NaN is above every bound
                o = (((x > low) | np.isnan(x) | np.isnan(low)) & ((x <= high) | np.isnan(high))).astype(float)
                for t, w in zip(at, weights, strict=True):
                    terms = z + t * (o - z)
                    ahead = np.cumprod(np.hstack([np.ones((len(x), 1)), terms[:, :-1]]), axis=1)
                    behind = np.cumprod(np.hstack([np.ones((len(x), 1)), terms[:, :0:-1]]), axis=1)[:, ::-1]
                    phi += value * w * (o - z) * ahead * behind
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(phi / p.trees), pa.list_(pa.float64()))], names=["key", "phi"])

    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    got = df.select(F.col(key).alias("key"), _vector(features)).mapInArrow(run, f"key {kind}, phi array<double>")
    names = F.array(*[F.lit(c) for c in features])
    return got.select("key", F.posexplode("phi").alias("i", "attribution")).select(
        F.col("key").alias(key), F.get(names, F.col("i")).alias("feature"), "attribution", F.lit(float(base)).alias("base"))
