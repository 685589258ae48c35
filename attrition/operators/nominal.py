"""MLlib's gradient-boosted trees of two classes (M7) over cells: log loss on labels ±1, regression
trees by variance, categories of a nominal feature ordered by their mean in each node.

All rows of the same bins have the same margin, so a round's residuals and sums follow from the
distinct rows of bins and their weight per class.  These cells come from one aggregation; their number is bounded by
the bins, not by the rows, and all rounds run over them in one task, where MLlib starts a job a level."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.operators.boost import _numbers, bin_edges, distinct, to_bins, _words
from attrition.session import cut_lineage, ship_package

#: Cells that one task may hold; beyond it MLlib fits the rows.
MOST_CELLS = 1 << 22


@dataclass(frozen=True)
class Settings:
    rounds: int
    learning_rate: float
    depth: int
    least_rows: int = 1


def grow(x: np.ndarray, weight: np.ndarray, target: np.ndarray, count: np.ndarray, levels: list[int], p: Settings, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A regression tree (``go``: whether a bin goes right) and the leaf of each cell.  ``target`` is
    weight times residual, ``levels`` the number of categories, 0 for a number."""
    node, k, done, made = np.zeros(len(x), np.int64), 1, 1, []
    base, n_feats, at = np.zeros(len(x), np.int64), x.shape[1], np.arange(len(x))
    for depth in range(p.depth + 1):
        w, s = np.bincount(node[at] - base[at], weight[at], k), np.bincount(node[at] - base[at], target[at], k)
        tree = {"feature": np.full(k, -1), "left": np.arange(done - k, done), "go": np.zeros((k, width), bool), "value": np.divide(s, w, out=np.zeros(k), where=w > 0)}
        made.append(tree)
        if depth == p.depth or not len(at):
            break
        best, where = np.zeros(k), np.arange(k)
        own = node[at] - base[at]
        for f in range(n_feats):
            key = own * width + x[at, f]
            sums = np.stack([np.bincount(key, v[at], k * width).reshape(k, width) for v in (weight, target, count)])
            order = np.broadcast_to(np.arange(width), (k, width))
            if levels[f]:
                mean = np.divide(sums[1], sums[0], out=np.full((k, width), np.inf), where=sums[0] > 0)
                order = np.argsort(mean, axis=1, kind="stable")
                sums = np.take_along_axis(sums, np.broadcast_to(order, sums.shape), axis=2)
            left = np.cumsum(sums, axis=2)
            right = left[..., -1:] - left
            ok = (left[2] >= p.least_rows) & (right[2] >= p.least_rows) & (left[0] > 0) & (right[0] > 0)
            part = [np.divide(v[1] * v[1], v[0], out=np.zeros((k, width)), where=ok) for v in (left, right)]
            gain = np.where(ok, part[0] + part[1] - np.divide(s * s, w, out=np.zeros(k), where=w > 0)[:, None], 0.0)
            cut = gain.argmax(axis=1)
            better = gain[where, cut] > best + 1e-10 * np.abs(w)
            best[better], tree["feature"][better] = gain[where, cut][better], f
            rank = np.empty((k, width), np.int64)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(width), (k, width)), axis=1)
            tree["go"][better] = (rank > cut[:, None])[better]
        split = np.flatnonzero(tree["feature"] >= 0)
        tree["left"][split] = done + 2 * np.arange(len(split))
        at = at[tree["feature"][own] >= 0]
        own = node[at] - base[at]
        node[at] = tree["left"][own] + tree["go"][own, x[at, tree["feature"][own]]]
        base[at], k, done = done, 2 * len(split), done + 2 * len(split)
    return {name: np.concatenate([t[name] for t in made]) for name in made[0]}, node


def fit_cells(x: np.ndarray, w0: np.ndarray, w1: np.ndarray, count: np.ndarray, levels: list[int], p: Settings, width: int) -> list[dict[str, np.ndarray]]:
    margin, trees = np.zeros(len(x)), []
    for number in range(p.rounds):
        target = w1 - w0 if number == 0 else 4 * w1 / (1 + np.exp(2 * margin)) - 4 * w0 / (1 + np.exp(-2 * margin))
        tree, leaf = grow(x, w0 + w1, target, count, levels, p, width)
        tree["value"] = tree["value"] * (1.0 if number == 0 else p.learning_rate)     # MLlib's first tree counts whole
        margin += tree["value"][leaf]
        trees.append(tree)
    return trees


def margins(trees: list[dict[str, np.ndarray]], x: np.ndarray, depth: int) -> np.ndarray:
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for t in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = t["feature"][node]
            node = np.where(f >= 0, t["left"][node] + t["go"][node, x[rows, f]], node)
        out += t["value"][node]
    return out


@dataclass(frozen=True)
class Boosted:
    trees: list[dict[str, np.ndarray]]
    edges: list[tuple[float, ...]]    # of a nominal feature: its categories but the last
    depth: int


def fit(df: DataFrame, x: str, levels: list[int], label: str, weight: str | None, p: Settings, max_bins: int) -> Boosted | None:
    """None where the rows make more cells than a task holds."""
    ship_package(df.sparkSession)
    names = [f"x{i}" for i in range(len(levels))]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*[F.col(x)[i].alias(n) for i, n in enumerate(names)], (F.col(label) > 0.5).alias("y"), w.alias("w"))
    numbers = [n for n, most in zip(names, levels, strict=True) if not most]
    cuts = dict(zip(numbers, bin_edges(rows, numbers, max_bins) if numbers else [], strict=True))
    edges = [cuts[n] if n in cuts else tuple(map(float, range(most - 1))) for n, most in zip(names, levels, strict=True)]
    width = max(map(len, edges)) + 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = to_bins(_numbers(b, range(len(edges))), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *[b.column(i) for i in (len(edges), len(edges) + 1)]], names=["x", "y", "w"])

    y = F.col("y")
    cells = rows.mapInArrow(binned, "x binary, y boolean, w double").groupBy("x").agg(
        F.sum(F.when(y, 0.0).otherwise(F.col("w"))).alias("w0"), F.sum(F.when(y, F.col("w")).otherwise(0.0)).alias("w1"), F.count(F.lit(1)).cast("double").alias("n"))
    cells = cut_lineage(cells)
    if cells.count() > MOST_CELLS:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b for b in batches if b.num_rows]).sort_by("x").combine_chunks()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(-1, len(edges))
        trees = fit_cells(x, *[table.column(c).to_numpy() for c in ("w0", "w1", "n")], levels, p, width)
        yield pa.RecordBatch.from_pydict({"trees": [pickle.dumps(trees)]})

    found = cells.coalesce(1).mapInArrow(run, "trees binary").collect()
    return Boosted(pickle.loads(bytes(found[0]["trees"])), edges, p.depth)


def score(model: Boosted, df: DataFrame, x: str, out: str) -> DataFrame:
    """``df`` with the margin."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def margin(v):
        import pandas as pd
        if not len(v):
            return pd.Series([], dtype=float)
        m = shared.value
        bins = to_bins(list(np.stack(v.to_list()).T), m.edges)
        first, place = distinct(_words(bins))
        return pd.Series(margins(m.trees, bins[first], m.depth)[place])

    return df.withColumn(out, margin(x))
