"""Random forests of two classes whose trees never meet in one process (M3).

MLlib's forest holds all nodes of all trees as objects on the driver and sums a whole
histogram for every node of every partition, also for nodes of two rows.  Both grow with
rows × trees.  Here a feature is cut into at most ``max_bins`` bins at its quantiles and the
rows are stored once as blocks of bin numbers.  While a node holds more than ``cell_rows``
rows, passes over the blocks sum its histograms and the best splits meet on executors; below
that, a task grows the rest of the node's tree (a cell) from the rows that reach it.  The grown cells are
stored as a table; the driver sees the few splits above them and the importances.

As in MLlib: rows enter a tree Poisson(1) times, every node draws its own features, gini
gain of weighted rows, ``min_rows`` counts drawn rows, two leaves of the same class are
merged, a forest's probability is the mean of its leaves' shares.  Every draw is a function of the
seed, the tree and the row's content and copy number (or the node's path), so neither
partitions nor the other trees change a tree: a forest of fewer trees, or of a lower
depth, is read from a larger one (:func:`fit` with ``depths``, :func:`score` with ``variants``)."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.operators.boost import _numbers, _uniform, _words, bin_edges, distinct, to_bins
from attrition.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Rows of a stored block, and of a node that a task grows on alone.
BLOCK_ROWS, CELL_ROWS = 1 << 15, 1 << 22
#: Rows of a block that is scored.
HELD_ROWS = 1 << 18
LEAST_GAIN = 1e-10
#: Shares are added as whole numbers of this unit: the order of the tasks does not matter.
UNIT = 1 << 40
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


@dataclass(frozen=True)
class Forest:
    trees: int
    max_depth: int
    min_rows: int = 1
    subset: int = 1                   # features that a node may choose from
    seed: int = 42
    max_bins: int = 32


def subset_size(strategy: str, n: int) -> int:
    """MLlib's ``featureSubsetStrategy`` as a number of features."""
    s = str(strategy)
    if s in ("auto", "sqrt"):
        return math.ceil(math.sqrt(n))
    if s in ("all", "onethird", "log2"):
        return {"all": n, "onethird": math.ceil(n / 3), "log2": max(1, math.ceil(math.log2(n)))}[s]
    return min(n, int(s)) if s.isdigit() else max(1, math.ceil(float(s) * n))


#: Draws by their first 12 bits; 255 where a bound of POISSON lies between.
_LOW, _HIGH = (np.searchsorted(POISSON, (np.arange(1 << 12) + end) / (1 << 12), side=side) for end, side in ((0, "right"), (1, "left")))
DRAWN = np.where(_LOW == _HIGH, _LOW, 255).astype(np.uint8)


def times_drawn(h: np.ndarray, p: Forest, tree: int) -> np.ndarray:
    out = np.empty(len(h), np.uint8)
    for lo in range(0, len(h), 1 << 15):     # a piece fits the processor's cache
        u = _uniform(h[lo:lo + (1 << 15)], p.seed * 15_485_863 + tree)
        c = DRAWN[(u * (1 << 12)).astype(np.int16)]
        open_ = np.flatnonzero(c == 255)
        c[open_] = np.searchsorted(POISSON, u[open_], side="right")
        out[lo:lo + (1 << 15)] = c
    return out.astype(np.int64)


class Rows:
    """Rows that a task grows trees on.  Those of the same bins stay together in every tree: they are
    summed as one (a cell) where that makes them fewer; an atom is a cell with one label and weight."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> None:
        self.x, self.y, self.w, self.h = x, y > 0.5, w, h
        first, cell = distinct(_words(x))
        self.fewer = 2 * len(first) <= len(x)
        if self.fewer:
            atoms, self.atom = distinct([cell, self.y, w])
            self.x, self.cell, self.y, self.w = x[first], cell[atoms], self.y[atoms], w[atoms]

    def drawn(self, p: Forest, tree: int) -> tuple[np.ndarray, ...]:
        """Bins, times drawn and weight of each class of what enters the tree."""
        c = times_drawn(self.h, p, tree)
        if self.fewer:
            c = np.bincount(self.atom, c, len(self.cell))
        w = self.w * c
        c, w0, w1 = c.astype(float), np.where(self.y, 0.0, w), np.where(self.y, w, 0.0)
        if self.fewer:
            c, w0, w1 = (np.bincount(self.cell, v, len(self.x)) for v in (c, w0, w1))
        at = np.flatnonzero(c)
        return self.x[at], c[at], w0[at], w1[at]


def features_of(paths: np.ndarray, n: int, p: Forest, tree: int) -> np.ndarray:
    """The features of each node, in ascending order."""
    if p.subset >= n:
        return np.broadcast_to(np.arange(n), (len(paths), n))
    draws = _uniform(((paths[:, None] << 8) | np.arange(n)).ravel(), p.seed * 32_452_843 + tree).reshape(len(paths), n)
    return np.sort(np.argsort(draws, axis=1, kind="stable")[:, :p.subset], axis=1)


def weighted_gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a + b
    return np.divide(2 * a * b, t, out=np.zeros_like(t), where=t > 0)


def best_splits(key: np.ndarray, c: np.ndarray, w0: np.ndarray, w1: np.ndarray, nodes: int, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Best gain (-inf: none) and bin of each node; ``key`` is node · width + bin of each
    row.  Only occupied bins are looked at, so small nodes cost their rows."""
    counts = np.bincount(key, c, nodes * width)
    at = np.flatnonzero(counts)
    node = at // width
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    last = np.r_[first[1:], len(at)] - 1

    def sums(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = v[at]
        total = np.cumsum(own)
        left = total - (total[first] - own[first])[node]
        return left, left[last][node] - left

    nl, nr = sums(counts)
    l0, r0 = sums(np.bincount(key, w0, nodes * width))
    l1, r1 = sums(np.bincount(key, w1, nodes * width))
    l0, l1, r0, r1 = (np.maximum(v, 0.0) for v in (l0, l1, r0, r1))
    gain = (weighted_gini(l0 + r0, l1 + r1) - weighted_gini(l0, l1) - weighted_gini(r0, r1)) / (l0 + r0 + l1 + r1)
    gain = np.where((nl >= least) & (nr >= least), gain, -np.inf)
    top = np.maximum.reduceat(gain, first)
    hits = np.flatnonzero(gain == top[node])[::-1]
    best = np.zeros(nodes, np.int64)
    best[node[hits]] = at[hits] % width      # backwards: the lowest bin stays
    return top, best


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, p: Forest, width: int, tree: int, path: int = 1, depth: int = 0) -> dict[str, np.ndarray]:
    """The tree under the node ``path`` from the rows that reach it."""
    return grow_drawn(*Rows(x, y, w, h).drawn(p, tree), p, width, tree, path, depth)


def grow_drawn(x: np.ndarray, c: np.ndarray, w0: np.ndarray, w1: np.ndarray, p: Forest, width: int, tree: int, path: int = 1, depth: int = 0) -> dict[str, np.ndarray]:
    """The tree of rows drawn ``c`` times, level after level; the right child's number is the left one's + 1."""
    flat, n_feats = x.ravel(), x.shape[1]
    start = np.arange(len(x)) * n_feats      # of each row in ``flat``
    node, paths, done, levels = np.zeros(len(x), np.int64), np.array([path]), 1, []
    while True:
        k = len(paths)
        t0, t1 = np.bincount(node, w0, k), np.bincount(node, w1, k)
        feature, cut, left, gains = np.full(k, -1, np.int16), np.zeros(k, np.uint8), np.full(k, -1, np.int32), np.zeros(k)
        levels.append({"feature": feature, "cut": cut, "left": left, "w0": t0, "w1": t1, "gain": gains, "level": np.full(k, depth, np.uint8)})
        mixed = (t0 > 0) & (t1 > 0)
        if depth >= p.max_depth or not mixed.any():
            break
        opened = np.flatnonzero(mixed)
        rows = np.flatnonzero(mixed[node])
        start, c, w0, w1 = start[rows], c[rows], w0[rows], w1[rows]
        node = (np.cumsum(mixed) - 1)[node[rows]]
        chosen = features_of(paths[opened], n_feats, p, tree).astype(np.int64)
        first = node * width
        gain, which, where = np.full(len(opened), -np.inf), np.zeros(len(opened), np.int64), np.zeros(len(opened), np.int64)
        for j in range(chosen.shape[1]):
            own = np.ascontiguousarray(chosen[:, j])
            g, b = best_splits(first + flat[start + own[node]], c, w0, w1, len(opened), width, p.min_rows)
            better = g > gain
            gain[better], which[better], where[better] = g[better], own[better], b[better]
        split = gain > LEAST_GAIN
        if not split.any():
            break
        at = opened[split]
        feature[at], cut[at], gains[at] = which[split], where[split], gain[split]
        left[at] = done + 2 * np.arange(len(at))
        done += 2 * len(at)
        rows = np.flatnonzero(split[node])
        start, c, w0, w1, node = start[rows], c[rows], w0[rows], w1[rows], node[rows]
        node = 2 * (np.cumsum(split) - 1)[node] + (flat[start + which[node]] > where[node])
        paths = np.stack([2 * paths[at], 2 * paths[at] + 1], axis=1).ravel()
        depth += 1
    return {name: np.concatenate([lv[name] for lv in levels]) for name in levels[0]}


def leaves(t: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """Whether a node is a leaf of the tree cut at ``depth``, leaves of one class merged."""
    leaf = (t["feature"] < 0) | (t["level"] >= depth)
    one = t["w1"] > t["w0"]
    for level in range(int(t["level"].max(initial=0)), -1, -1):
        at = np.flatnonzero((t["level"] == level) & ~leaf)
        a = t["left"][at]
        leaf[at] = leaf[a] & leaf[a + 1] & (one[a] == one[a + 1])
    return leaf


def importance(t: dict[str, np.ndarray], leaf: np.ndarray, n_feats: int) -> np.ndarray:
    """Gain times weight of each feature's splits."""
    seen = np.zeros(len(leaf), bool)
    seen[0] = True
    out = np.zeros(n_feats)
    for level in np.unique(t["level"]):
        at = np.flatnonzero((t["level"] == level) & seen & ~leaf)
        seen[t["left"][at]] = seen[t["left"][at] + 1] = True
        out += np.bincount(t["feature"][at], t["gain"][at] * (t["w0"][at] + t["w1"][at]), n_feats)
    return out


def descend(t: dict[str, np.ndarray], leaf: np.ndarray, x: np.ndarray) -> np.ndarray:
    node, at = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(at):
        at = at[~leaf[node[at]]]
        now = node[at]
        node[at] = t["left"][now] + (x[at, t["feature"][now]] > t["cut"][now])
    return node


def share(t: dict[str, np.ndarray]) -> np.ndarray:
    total = t["w0"] + t["w1"]
    return np.round(np.divide(t["w1"], total, out=np.zeros(len(total)), where=total > 0) * UNIT).astype(np.int64)


# --- on Spark -----------------------------------------------------------------

@dataclass(frozen=True)
class Grown:
    """A fitted forest: ``cells`` (cell, tree) are stored; ``tops`` are the trees above the
    cells, ``cell`` in them naming the stored one (-1: none), ``merged`` for each depth."""
    p: Forest
    edges: list[tuple[float, ...]]
    tops: list[dict[str, np.ndarray]]
    depths: tuple[int, ...]
    merged: dict[int, list[np.ndarray]]
    cells: DataFrame
    by_tree: dict[int, np.ndarray]    # for each depth the features' importance in each tree

    @property
    def importances(self) -> np.ndarray:
        return self.importances_of(self.p.trees, self.p.max_depth)

    def importances_of(self, trees: int, depth: int) -> np.ndarray:
        """Of the first trees, cut at a depth."""
        total = self.by_tree[depth][:trees].sum(axis=0)
        return total / total.sum() if total.sum() > 0 else total


def _columns(df: DataFrame, x: str, n: int) -> list:
    return [F.col(x)[i].cast("double").alias(f"x{i}") for i in range(n)]


def _stored(rows: DataFrame, n: int, edges: list[tuple[float, ...]]) -> DataFrame:
    """Blocks of rows, ordered by content; copies of a row have a number of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        b = pa.Table.from_batches(got).sort_by("h").combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        y, w = _numbers(b, range(len(edges), len(edges) + 2))
        h = b.column(len(edges) + 2).to_numpy().astype(np.int64)
        new = np.r_[True, h[1:] != h[:-1]]
        copy = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        with np.errstate(over="ignore"):
            h = (h.view(np.uint64) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        yield pa.RecordBatch.from_pydict({k: [np.ascontiguousarray(a).tobytes()] for k, a in
                                          zip("xywh", (to_bins(_numbers(b, range(len(edges))), edges), y, w, h), strict=True)})

    return cut_lineage(rows.repartition(max(1, n // BLOCK_ROWS), "h").mapInArrow(run, "x binary, y binary, w binary, h binary"))


def _empty_top() -> dict[str, list]:
    return {"feature": [-1], "cut": [0], "left": [-1], "w0": [0.0], "w1": [0.0], "gain": [0.0], "level": [0], "path": [1], "rows": [0.0], "cell": [-1]}


def _arrays(top: dict[str, list]) -> dict[str, np.ndarray]:
    kinds = {"w0": float, "w1": float, "gain": float, "rows": float}
    return {k: np.array(v, kinds.get(k, np.int64)) for k, v in top.items()}


def _grow_tops(blocks, n: int, p: Forest, n_feats: int, width: int, cell_rows: int) -> list[dict[str, list]]:
    """Splits of all nodes that hold more rows than a cell may, a level a pass."""
    tops = [_empty_top() for _ in range(p.trees)]
    wanted = [(t, 0) for t in range(p.trees)] if n > cell_rows else []
    while wanted:
        flat, open_ = [_arrays(t) for t in tops], {}
        for t, node in wanted:
            open_.setdefault(t, []).append(node)

        def sums(block) -> Iterator[tuple]:
            x, y, w, h = block
            for t, nodes in open_.items():
                c = times_drawn(h, p, t)
                at = np.flatnonzero(c)
                ends = descend(flat[t], flat[t]["feature"] < 0, x[at])
                for node in nodes:
                    own = at[ends == node]
                    if len(own):
                        place = (np.arange(n_feats) * width + x[own]).ravel()
                        k, one = c[own].astype(float), y[own] > 0.5
                        parts = (k, np.where(one, 0.0, w[own] * k), np.where(one, w[own] * k, 0.0))
                        yield (t, node), np.stack([np.bincount(place, np.repeat(v, n_feats), n_feats * width) for v in parts])

        def best(item) -> tuple:
            (t, node), s = item
            bins = np.arange(n_feats * width)
            gain, cut = best_splits(bins, *(s + 0.0), n_feats, width, p.min_rows)
            allowed = features_of(np.array([flat[t]["path"][node]]), n_feats, p, t)[0]
            f = int(allowed[np.argmax(gain[allowed])])
            own = s[:, f * width:(f + 1) * width]
            left = own[:, :int(cut[f]) + 1].sum(axis=1)
            return t, node, f, int(cut[f]), float(gain[f]), left.tolist(), (own.sum(axis=1) - left).tolist()

        found = blocks.flatMap(sums).reduceByKey(lambda a, b: a + b).map(best).collect()
        wanted = []
        for t, node, f, cut, gain, *sides in sorted(found):
            top = tops[t]
            top["rows"][node], top["w0"][node], top["w1"][node] = (a + b for a, b in zip(*sides, strict=True))
            if not gain > LEAST_GAIN or top["level"][node] >= p.max_depth:
                continue
            top["feature"][node], top["cut"][node], top["gain"][node], top["left"][node] = f, cut, gain, len(top["left"])
            for right, (rows, w0, w1) in enumerate(sides):
                for name, v in {"feature": -1, "cut": 0, "left": -1, "w0": w0, "w1": w1, "gain": 0.0, "level": top["level"][node] + 1,
                                "path": 2 * top["path"][node] + right, "rows": rows, "cell": -1}.items():
                    top[name].append(v)
                if rows > cell_rows and min(w0, w1) > 0 and top["level"][-1] < p.max_depth:
                    wanted.append((t, len(top["left"]) - 1))
    return tops


def fit(df: DataFrame, x: str, n_feats: int, label: str, weight: str | None, p: Forest, n: int, depths: tuple[int, ...] = (),
        cell_rows: int = CELL_ROWS) -> Grown:
    """The forest of the ``n`` rows of ``df``, features in the array ``x``.  ``depths``:
    further depths at which it will be read."""
    return fit_many(df, x, n_feats, label, weight, [p], n, [depths], cell_rows)[0]


def fit_many(df: DataFrame, x: str, n_feats: int, label: str, weight: str | None, ps: list[Forest], n: int, depths: list[tuple[int, ...]],
             cell_rows: int = CELL_ROWS) -> list[Grown]:
    """Forests of the same rows (and ``max_bins``), in one pass where a task may hold the rows."""
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    names = [f"x{i}" for i in range(n_feats)]
    rows = df.select(*_columns(df, x, n_feats), F.col(label).cast("double").alias("y"), w.alias("w"))
    edges = bin_edges(rows, names, ps[0].max_bins)
    width = max(map(len, edges)) + 1
    stored = _stored(rows.withColumn("h", F.xxhash64(*rows.columns)), n, edges)
    depths = [tuple(sorted({*d, p.max_depth})) for d, p in zip(depths, ps, strict=True)]

    def opened(row) -> tuple:
        x, y, w, h = (np.frombuffer(bytes(v), t) for v, t in zip(row, (np.uint8, float, float, np.int64), strict=True))
        return x.reshape(-1, n_feats), y, w, h

    blocks = stored.rdd.map(opened)
    tops = [_grow_tops(blocks, n, p, n_feats, width, cell_rows) for p in ps]
    cells = []                        # (forest, tree, path, level): numbered by place
    for i, forest in enumerate(tops):
        for t, top in enumerate(forest):
            for node, f in enumerate(top["feature"]):
                if f < 0:
                    top["cell"][node] = len(cells)
                    cells.append((i, t, top["path"][node], top["level"][node]))
    flat = [[_arrays(t) for t in forest] for forest in tops]
    whole = len(cells) == sum(p.trees for p in ps)     # no tree has a top: tasks take several trees and all rows
    tasks = max(1, min(max(p.trees for p in ps), 2 * spark.sparkContext.defaultParallelism) if whole else min(len(cells), 512))
    shares: dict[int, list[int]] = {}
    for cell, (_, t, _, _) in enumerate(cells):
        shares.setdefault(t % tasks if whole else cell, []).append(cell)

    def sent(block) -> Iterator[tuple]:
        x, y, w, h = block
        if whole:
            yield from ((g, (-1, block)) for g in range(tasks))
            return
        for p, forest in zip(ps, flat, strict=True):
            for t, top in enumerate(forest):
                at = np.flatnonzero(times_drawn(h, p, t))
                ends = top["cell"][descend(top, top["feature"] < 0, x[at])]
                order = np.argsort(ends, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(ends[order])) + 1):
                    if len(part):
                        own = at[part]
                        yield int(ends[part[0]]), (int(ends[part[0]]), (x[own], y[own], w[own], h[own]))

    def grown(item) -> Iterator[tuple]:
        key, pieces = item
        pieces = sorted((b for _, b in pieces), key=lambda b: int(b[3][0]))
        rows, drawn, last = Rows(*(np.concatenate(v) for v in zip(*pieces, strict=True))), None, None
        del pieces
        for cell in sorted(shares[key], key=lambda c: (cells[c][1], c)):
            i, t, path, level = cells[cell]
            p = ps[i]
            if last != (p.seed, t):   # forests of the same seed draw the same rows
                drawn, last = rows.drawn(p, t), (p.seed, t)
            tree = grow_drawn(*drawn, p, width, t, path, level)
            cut = [leaves(tree, d) for d in depths[i]]
            roots, imp = [bool(leaf[0]) for leaf in cut], np.concatenate([importance(tree, leaf, n_feats) for leaf in cut])
            yield cell, bytearray(pickle.dumps(tree)), [float(v) for v in imp], roots, float(tree["w0"][0]), float(tree["w1"][0])

    made = blocks.flatMap(sent).groupByKey(tasks, int).flatMap(grown)
    kept = cut_lineage(spark.createDataFrame(made, "cell int, tree binary, imp array<double>, roots array<boolean>, w0 double, w1 double"))
    facts = {r["cell"]: r for r in kept.drop("tree").collect()}
    out, low = [], 0
    for p, forest, own in zip(ps, flat, depths, strict=True):
        high = low + sum(int((top["cell"] >= 0).sum()) for top in forest)
        out.append(_read(p, edges, forest, own, facts, kept.where(F.col("cell").between(low, high - 1)).select("cell", "tree")))
        low = high
    return out


def _read(p: Forest, edges: list[tuple[float, ...]], flat: list[dict[str, np.ndarray]], depths: tuple[int, ...], facts: dict, cells: DataFrame) -> Grown:
    """The forest, its leaves merged at each depth, and its importances."""
    merged: dict[int, list[np.ndarray]] = {}
    n_feats = len(edges)
    by_tree: dict[int, np.ndarray] = {}
    for i, d in enumerate(depths):
        merged[d], by_tree[d] = [], np.zeros((len(flat), n_feats))
        for t, top in enumerate(flat):
            leaf = top["level"] >= d
            for node in np.flatnonzero(top["feature"] < 0):
                r = facts.get(int(top["cell"][node]))
                if r is not None:
                    top["w0"][node], top["w1"][node] = r["w0"], r["w1"]
                leaf[node] = r is None or r["roots"][i]
            for node in range(len(leaf) - 1, -1, -1):
                a = int(top["left"][node])
                if top["feature"][node] >= 0 and not leaf[node]:
                    one = top["w1"] > top["w0"]
                    leaf[node] = leaf[a] and leaf[a + 1] and one[a] == one[a + 1]
            merged[d].append(leaf)
            own = importance(top, leaf | (top["feature"] < 0), n_feats)
            alive = _reached(top, leaf)
            for node in np.flatnonzero((top["feature"] < 0) & alive & ~leaf):
                own = own + np.array(facts[int(top["cell"][node])]["imp"][i * n_feats:(i + 1) * n_feats])
            by_tree[d][t] = own / own.sum() if own.sum() > 0 else 0.0
    return Grown(p, edges, flat, depths, merged, cells, by_tree)


def _reached(t: dict[str, np.ndarray], leaf: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(leaf), bool)
    seen[0] = True
    for node in range(len(leaf)):
        if seen[node] and not leaf[node] and t["feature"][node] >= 0:
            seen[t["left"][node]:t["left"][node] + 2] = True
    return seen


def score(g: Grown, df: DataFrame, row: str, x: str, variants: list[tuple[int, int]] | None = None) -> DataFrame:
    """(variant, ``row``, p) of the rows of ``df``, numbered uniquely by ``row``; a variant is
    the forest's first trees, cut at a depth, by default all of it."""
    spark = df.sparkSession
    variants = variants or [(g.p.trees, g.p.max_depth)]
    edges, tops, merged, n_feats = g.edges, g.tops, g.merged, len(g.edges)
    whole = all(len(t["feature"]) == 1 for t in tops)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            b = pa.Table.from_batches(got).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
            for lo in range(0, b.num_rows, HELD_ROWS):
                part = b.slice(lo, HELD_ROWS)
                ids = part.column(n_feats).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_pydict({"block": [int(ids[0])], "x": [to_bins(_numbers(part, range(n_feats)), edges).tobytes()], "ids": [ids.tobytes()]})

    rows = df.select(*_columns(df, x, n_feats), F.col(row).cast("long").alias("id"))
    held = cut_lineage(rows.coalesce(max(1, rows.count() // HELD_ROWS)).mapInArrow(binned, "block long, x binary, ids binary"))
    number = {b: i for i, b in enumerate(sorted(r[0] for r in held.select("block").collect()))}
    n_blocks = max(1, len(number))
    groups = min(len(tops), max(1, 2 * spark.sparkContext.defaultParallelism // n_blocks)) if whole else 0
    tree_of = {int(c): t for t, top in enumerate(tops) for c in top["cell"] if c >= 0}
    partitions = max(1, min(512, (groups or len(tree_of)) * n_blocks, 8 * spark.sparkContext.defaultParallelism))

    def unit(cell: int) -> int:
        return cell % groups if groups else cell

    most = max(trees for trees, _ in variants)

    def trees(r) -> Iterator[tuple]:
        for b in range(n_blocks if tree_of[r["cell"]] < most else 0):
            yield unit(r["cell"]) * n_blocks + b, (r["cell"], bytes(r["tree"]))

    def pieces(r) -> Iterator[tuple]:
        x, b = np.frombuffer(bytes(r["x"]), np.uint8).reshape(-1, n_feats), number[r["block"]]
        if whole:
            yield from ((u * n_blocks + b, (r["block"], len(x), None, x)) for u in range(groups))
            return
        for t, top in enumerate(tops):
            ends = top["cell"][descend(top, top["feature"] < 0, x)]
            for cell in np.unique(ends).tolist():
                own = np.flatnonzero(ends == cell).astype(np.int32)
                yield cell * n_blocks + b, (r["block"], len(x), own, x[own])

    def added(part) -> Iterator[tuple]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for _, (cells, rows) in part:
            rows, place = list(rows), {}
            if whole:                 # rows of the same bins meet the same leaves
                for i, (block, size, own, x) in enumerate(rows):
                    first, place[block] = distinct(_words(x))
                    rows[i] = block, len(first), own, x[first]
            for cell, blob in cells:
                tree, t = pickle.loads(blob), tree_of[cell]
                p1, by_depth = share(tree), {}
                for v, (n_trees, depth) in enumerate(variants):
                    # rows that end above the cells are added once, from the tree's top
                    if t >= n_trees:
                        continue
                    for i, (block, size, own, x) in enumerate(rows):
                        if (i, depth) not in by_depth:
                            if ("leaf", depth) not in by_depth:
                                by_depth["leaf", depth] = leaves(tree, depth)
                            values = p1[descend(tree, by_depth["leaf", depth], x)]
                            if not whole:
                                top = tops[t]
                                above = descend(top, merged[depth][t] | (top["feature"] < 0), x)
                                values = np.where(top["feature"][above] >= 0, share(top)[above], values)
                            by_depth[i, depth] = values
                        out = sums.setdefault((block, v), np.zeros(size, np.int64))
                        if own is None:
                            out += by_depth[i, depth]
                        else:
                            out[own] += by_depth[i, depth]
            if whole:
                yield from (((block, v), own[place[block]]) for (block, v), own in sums.items())
                sums = {}
            if len(sums) > 64:
                yield from sums.items()
                sums = {}
        yield from sums.items()

    parts = g.cells.rdd.flatMap(trees).cogroup(held.rdd.flatMap(pieces), partitions).mapPartitions(added).reduceByKey(lambda a, b: a + b, max(1, min(partitions, n_blocks * len(variants))))
    sums = parts.map(lambda kv: (kv[0][0], (kv[0][1], kv[1].tobytes()))).join(held.rdd.map(lambda r: (r["block"], bytes(r["ids"]))), max(1, min(partitions, n_blocks)))
    stored = cut_lineage(spark.createDataFrame(sums.map(lambda kv: (kv[1][0][0], bytearray(kv[1][1]), bytearray(kv[1][0][1]))), "variant int, ids binary, sums binary"))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v, ids, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), v, np.int32)), pa.array(ids), pa.array(np.frombuffer(s, np.int64) / (variants[v][0] * UNIT))],
                                                 names=["variant", row, "p"])

    return stored.mapInArrow(rows_of, f"variant int, {row} long, p double")
