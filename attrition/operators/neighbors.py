"""Exact k-nearest-neighbour joins without a cross join (J2, J3, J5 support).

Plan
----
1. **Duplicate compression.**  Reference rows are grouped by their feature
   vector; each distinct vector keeps its ``k + 1`` smallest ids (salted
   two-stage top-k, so a vector shared by a third of all rows never lands in
   one task).  Identical query rows share one neighbour search.
2. **Cells.**  A k-d tree of at most ``MAX_CELLS`` leaves cuts the space.  Its
   cuts come from a bounded sample of the vectors, which only decides how even
   the cells are; every vector is then put into its cell, and each cell gets the
   exact box of its vectors.  Nominal columns are dimensions too: two cells that
   differ there are the penalty apart.
3. **Search.**  Each query meets its own cell; the k-th distance D found there
   bounds the true one.  It then meets every other cell whose box is no
   further away than D, so no neighbour can be missed.  A query whose own cell holds
   fewer than k vectors gets D from the boxes: the radius that surely covers k vectors.
   Cells and their queries meet in one group each; the queries of a
   crowded cell are dealt out over several.  Vectors that a task may hold all of
   (``WHOLE_ROWS``) are sent to groups of queries instead, where the same search runs without a shuffle a step.
4. **Expansion.**  Vector-level neighbours are expanded into ids, the query
   itself is dropped (self-join), and ties are broken by ``(distance, id)``.

Distances: ``euclidean`` (ranked on the squared distance), ``manhattan``;
``nominal`` columns add ``nominal_penalty`` (already squared for euclidean)
per mismatch (the SMOTE-NC distance).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.session import cut_lineage, ship_package

SALTS = 16
#: Leaves of the tree, and vectors that its cuts are drawn from.
MAX_CELLS, TREE_ROWS = 8_192, 1 << 17
#: Queries that meet a cell in one group, and distances held at once.
GROUP_QUERIES, PAIRS = 1 << 16, 1 << 20
#: Rows of a partition that tasks in Python read, and cells of a task that searches.
TASK_ROWS, TASK_CELLS = 1 << 14, 2
#: Vectors that a task may hold all of, from which number it does, how often they may be sent in all, and the queries met so.
WHOLE_ROWS, WHOLE_FROM, WHOLE_PAIRS, WHOLE_QUERIES = 1 << 20, 1 << 14, 1 << 22, 1 << 23
#: Types whose values are doubles as they are; others are told apart by 53 bits of a hash.
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)


def _compress(ref: DataFrame, key: str, cols: list[str], keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids, the smallest being ``vid``."""
    salted = ref.select(key, *cols, (F.abs(F.xxhash64(key)) % SALTS).alias("__salt"))
    w1 = Window.partitionBy(*cols, "__salt").orderBy(key)
    stage1 = salted.withColumn("__rn", F.row_number().over(w1)).where(F.col("__rn") <= keep)
    # at most SALTS * keep rows per vector reach this aggregate
    ids = stage1.groupBy(*cols).agg(F.slice(F.array_sort(F.collect_list(key)), 1, keep).alias("ids"))
    return ids.withColumn("vid", F.get("ids", F.lit(0)))


class Space(NamedTuple):
    """What a distance is made of: numbers, then nominal columns, then columns that must
    be equal (``within``); apart from these, columns that must differ (``apart``)."""

    numbers: int
    nominals: int
    withins: int
    aparts: int
    metric: str
    penalty: float

    @property
    def dims(self) -> int:
        return self.numbers + self.nominals + self.withins

    @property
    def columns(self) -> list[str]:
        return [f"x{i}" for i in range(self.dims + self.aparts)]

    def steps(self) -> np.ndarray:
        """What a mismatch in a column adds at least."""
        return np.array([self.penalty] * self.nominals + [math.inf] * self.withins)

    def beyond(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """A lower bound of the rank of whatever lies in the box."""
        n = self.numbers
        gap = np.maximum(np.maximum(lo[:n] - x[:, :n], x[:, :n] - hi[:n]), 0.0)
        out = (gap * gap if self.metric == "euclidean" else gap).sum(axis=1)
        for i, step in enumerate(self.steps(), n):
            out = out + np.where((x[:, i] < lo[i]) | (x[:, i] > hi[i]), step, 0.0)
        return out

    def reach(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """An upper bound of the rank of whatever lies in each of the boxes, for one ``x``."""
        n = self.numbers
        gap = np.maximum(np.abs(x[:n] - lo[:, :n]), np.abs(x[:n] - hi[:, :n]))
        out = (gap * gap if self.metric == "euclidean" else gap).sum(axis=1)
        for i, step in enumerate(self.steps(), n):
            out = out + np.where((lo[:, i] == x[i]) & (hi[:, i] == x[i]), 0.0, step)
        return out

    def ranks(self, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Distances (euclidean: squared) of all queries and vectors; infinite where they must not meet."""
        out = None
        for i in range(self.dims):
            if i < self.numbers:
                diff = q[:, i, None] - r[None, :, i]
                term = diff * diff if self.metric == "euclidean" else np.abs(diff)
            else:
                term = np.where(q[:, i, None] != r[None, :, i], self.steps()[i - self.numbers], 0.0)
            out = term if out is None else out + term
        for i in range(self.dims, self.dims + self.aparts):
            out[q[:, i, None] == r[None, :, i]] = math.inf
        return out


class Tree(NamedTuple):
    """Cut dimension (-1: a leaf), cut value, children by node; leaf number by node."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), dtype=np.int64)
        while len(x):
            inner = np.flatnonzero(self.dim[at] >= 0)
            if not len(inner):
                break
            node = at[inner]
            at[inner] = np.where(x[inner, self.dim[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.leaf[at]

    def boxes(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of all nodes from those of the leaves (children come after their parent)."""
        own_lo, own_hi = np.empty((len(self.dim), lo.shape[1])), np.empty((len(self.dim), lo.shape[1]))
        for n in range(len(self.dim) - 1, -1, -1):
            if self.dim[n] < 0:
                own_lo[n], own_hi[n] = lo[self.leaf[n]], hi[self.leaf[n]]
            else:
                own_lo[n] = np.minimum(own_lo[self.left[n]], own_lo[self.right[n]])
                own_hi[n] = np.maximum(own_hi[self.left[n]], own_hi[self.right[n]])
        return own_lo, own_hi


def grow(x: np.ndarray, space: Space, cells: int) -> Tree:
    """A tree of about ``cells`` leaves with even shares of ``x``.  A node is cut at the median
    of its widest dimension, columns that must be equal first."""
    most = max(1.0, len(x) / max(1, cells))
    dim, cut, left, right, leaf, leaves = [], [], [], [], [], 0
    todo = [(np.arange(len(x)), -1, False)]
    steps = space.steps() if space.metric != "euclidean" else np.sqrt(space.steps())
    while todo:
        rows, parent, is_right = todo.pop()
        node = len(dim)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        for column in (dim, left, right, leaf):
            column.append(-1)
        cut.append(0.0)
        if len(rows) > most:
            own = x[rows][:, :space.dims]
            wide = own.max(axis=0) - own.min(axis=0)
            wide[space.numbers:] = np.where(wide[space.numbers:] > 0, steps, 0.0)
            d = int(wide.argmax())
            if wide[d] > 0:
                values = own[:, d]
                at = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
                if at == values.max():
                    at = values[values < at].max()
                dim[node], cut[node] = d, at
                todo += [(rows[values > at], node, True), (rows[values <= at], node, False)]
                continue
        leaf[node], leaves = leaves, leaves + 1
    return Tree(np.array(dim), np.array(cut), np.array(left), np.array(right), np.array(leaf))


def _matrix(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(n), dtype=float) for n in names])


def _nearest(space: Space, q: np.ndarray, r: np.ndarray, most: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, rank) of the ``most`` nearest vectors of each query, by query, rank and the
    vectors' order; with ``bound`` of those no further away only."""
    found = []
    step = max(1, PAIRS // max(1, len(r)))
    for at in range(0, len(q) if len(r) else 0, step):
        d = space.ranks(q[at:at + step], r)
        top = np.full(len(d), np.inf) if bound is None else bound[at:at + step]
        if bound is None and len(r) > most:
            top = np.partition(d, most - 1, axis=1)[:, most - 1]
        i, j = np.nonzero((d <= top[:, None]) & (d < np.inf))
        rank = d[i, j]
        order = np.lexsort((j, rank, i))
        i, j, rank = i[order], j[order], rank[order]
        first = np.searchsorted(i, np.arange(len(d)))
        keep = np.arange(len(i)) - first[i] < most
        found.append((i[keep] + at, j[keep], rank[keep]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


class _Cells:
    """Reference vectors in the cells of a tree."""

    def __init__(self, dv: DataFrame, space: Space, n: int, per_cell: int) -> None:
        self.space, self.names = space, space.columns
        share = min(1.0, TREE_ROWS / max(1, n))
        drawn = dv.where(F.pmod(F.xxhash64(*self.names), F.lit(1 << 30)) < int(share * (1 << 30))).select(*self.names)
        self.tree = grow(_matrix(drawn.toArrow(), self.names), space, min(MAX_CELLS, math.ceil(n / per_cell)))
        self.tasks = math.ceil((int(self.tree.leaf.max()) + 1) / TASK_CELLS)
        self.refs = cut_lineage(self.placed(dv))
        dims = self.names[:space.dims]
        by = self.refs.groupBy("cell", *self.names[space.dims:]).agg(
            F.count("*").alias("n"), *[f(c).alias(f"{a}_{c}") for c in dims for f, a in ((F.min, "lo"), (F.max, "hi"))])
        sure = F.sum("n") - F.max("n") if space.aparts else F.sum("n")
        table = by.groupBy("cell").agg(sure.cast("double").alias("sure"), *[f(f"{a}_{c}").alias(f"{a}_{c}") for c in dims for f, a in ((F.min, "lo"), (F.max, "hi"))]).toArrow()
        cells, at = int(self.tree.leaf.max()) + 1, table.column("cell").to_numpy()
        # a cell without vectors has an empty box, which nothing is near to
        self.sure, self.lo, self.hi = np.zeros(cells), np.full((cells, space.dims), np.inf), np.full((cells, space.dims), -np.inf)
        self.sure[at] = table.column("sure").to_numpy()
        self.lo[at], self.hi[at] = _matrix(table, [f"lo_{c}" for c in dims]), _matrix(table, [f"hi_{c}" for c in dims])

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of the cell."""
        tree, names = self.tree, self.names

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = tree.place(_matrix(batch, names)) if batch.num_rows else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "cell"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.LongType())]))

    def _ids(self) -> list[T.StructField]:
        key = self.refs.schema["vid"].dataType
        return [T.StructField("vid", key), T.StructField("ids", T.ArrayType(key, self.refs.schema["ids"].dataType.containsNull))]

    def _meet(self, queries: DataFrame, search, schema: T.StructType) -> DataFrame:
        """Each cell with its queries in groups of about GROUP_QUERIES."""
        crowd = {r.cell: math.ceil(r.n / GROUP_QUERIES) for r in queries.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_QUERIES).collect()}
        parts = F.lit(1)
        if crowd:
            parts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in crowd.items() for v in kv]), F.col("cell")), F.lit(1))
        refs = self.refs.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = queries.withColumn("part", F.pmod(F.xxhash64("qvid"), parts).cast("int"))
        asked, known = (df.repartition(self.tasks, "cell", "part").groupBy("cell", "part") for df in (dealt, refs))
        return asked.cogroup(known).applyInArrow(search, schema)

    def own(self, queries: DataFrame, most: int) -> DataFrame:
        """Each query with the nearest vectors of its own cell and the rank that bounds the true ones."""
        space, names, sure, lo, hi = self.space, self.names, self.sure, self.lo, self.hi
        item = T.StructType([T.StructField("__rank", T.DoubleType()), *self._ids()])
        schema = T.StructType([queries.schema["qvid"], *[queries.schema[c] for c in names], T.StructField("cell", T.LongType()),
                               T.StructField("bound", T.DoubleType()), T.StructField("best", T.ArrayType(item))])

        def surely(x: np.ndarray) -> float:
            far = space.reach(x, lo, hi)
            far[sure == 0] = np.inf
            order = np.argsort(far, kind="stable")
            at = np.searchsorted(np.cumsum(sure[order]), most)
            return float(far[order[at]]) if at < len(order) else math.inf

        def search(asked: pa.Table, known: pa.Table) -> pa.Table:
            if known.num_rows:
                known = known.sort_by("vid")
            q = _matrix(asked, names)
            i, j, rank = _nearest(space, q, _matrix(known, names), most)
            ends = np.searchsorted(i, np.arange(len(q) + 1))
            full = np.diff(ends) == most
            bound = np.empty(len(q))
            bound[full] = rank[ends[1:][full] - 1]
            for at in np.flatnonzero(~full):
                bound[at] = surely(q[at])
            taken = [pa.array(rank), *[known.column(c).combine_chunks().take(pa.array(j)) for c in ("vid", "ids")]]
            best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(taken, names=["__rank", "vid", "ids"]))
            return pa.table([asked.column(c) for c in ["qvid", *names, "cell"]] + [pa.array(bound), best], names=["qvid", *names, "cell", "bound", "best"])

        return self._meet(queries, search, schema)

    def others(self, seeded: DataFrame, most: int) -> DataFrame:
        """(qvid, __rank, vid, ids) from all other cells that reach into the bound."""
        space, names, tree = self.space, self.names, self.tree
        lo, hi = tree.boxes(self.lo, self.hi)
        asked = seeded.select("qvid", *names, "cell", "bound")

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, own, bound = _matrix(batch, names), batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
                limit = bound * (1 + 1e-9) + 1e-300
                todo, met, cells = [(0, np.arange(len(x)))], [], []
                while todo:
                    node, rows = todo.pop()
                    gap = space.beyond(x[rows], lo[node], hi[node])
                    rows = rows[(gap <= limit[rows]) & (gap < np.inf)]
                    if not len(rows):
                        continue
                    if tree.dim[node] < 0:
                        rows = rows[own[rows] != tree.leaf[node]]
                        met.append(rows)
                        cells.append(np.full(len(rows), tree.leaf[node]))
                    else:
                        todo += [(tree.left[node], rows), (tree.right[node], rows)]
                at = np.concatenate(met) if met else np.zeros(0, dtype=np.int64)
                to = np.concatenate(cells) if cells else np.zeros(0, dtype=np.int64)
                for start in range(0, len(at), GROUP_QUERIES):
                    part = batch.take(pa.array(at[start:start + GROUP_QUERIES]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[start:start + GROUP_QUERIES], pa.int64()) if n == "cell" else part.column(n)
                                                      for n in part.schema.names], names=part.schema.names)

        def search(asked: pa.Table, known: pa.Table) -> pa.Table:
            if known.num_rows:
                known = known.sort_by("vid")
            i, j, rank = _nearest(space, _matrix(asked, names), _matrix(known, names), most, asked.column("bound").to_numpy())
            return pa.table([asked.column("qvid").combine_chunks().take(pa.array(i)), pa.array(rank),
                             *[known.column(c).combine_chunks().take(pa.array(j)) for c in ("vid", "ids")]], names=["qvid", "__rank", "vid", "ids"])

        schema = T.StructType([seeded.schema["qvid"], T.StructField("__rank", T.DoubleType()), *self._ids()])
        return self._meet(asked.mapInArrow(walk, asked.schema), search, schema)


def search_whole(space: Space, q: np.ndarray, r: np.ndarray, most: int, per_cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`_nearest` over the cells of a tree of all vectors: each query's own cell bounds what it has to meet."""
    tree = grow(r, space, math.ceil(len(r) / per_cell))
    at, own = tree.place(r), tree.place(q)
    order = np.argsort(at, kind="stable")
    cells = np.split(order, np.searchsorted(at[order], np.arange(1, int(tree.leaf.max()) + 1)))
    x = [r[c] for c in cells]
    full = np.full(space.dims, np.inf)
    lo, hi = tree.boxes(np.stack([v[:, :space.dims].min(axis=0, initial=np.inf) for v in x]), np.stack([v[:, :space.dims].max(axis=0, initial=-np.inf) if len(v) else -full for v in x]))
    bound, found = np.full(len(q), np.inf), []

    def meet(rows: np.ndarray, cell: int, limit: np.ndarray | None) -> None:
        i, j, rank = _nearest(space, q[rows], x[cell], most, limit)
        if limit is None:
            last = np.flatnonzero(np.bincount(i, minlength=len(rows)) == most)
            bound[rows[last]] = rank[np.searchsorted(i, last, side="right") - 1]
        found.append((rows[i], cells[cell][j], rank))

    by_cell = np.argsort(own, kind="stable")
    for rows in np.split(by_cell, np.flatnonzero(np.diff(own[by_cell])) + 1):
        if len(rows):
            meet(rows, int(own[rows[0]]), None)
    limit = bound * (1 + 1e-9) + 1e-300
    todo = [(0, np.arange(len(q)))]
    while todo:
        node, rows = todo.pop()
        rows = rows[(gap := space.beyond(q[rows], lo[node], hi[node])) <= limit[rows]] if len(rows) else rows
        if not len(rows):
            continue
        if tree.dim[node] >= 0:
            todo += [(tree.left[node], rows), (tree.right[node], rows)]
        elif len(rows := rows[own[rows] != tree.leaf[node]]):
            meet(rows, int(tree.leaf[node]), bound[rows])
    i, j, rank = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((j, rank, i))
    i, j, rank = i[order], j[order], rank[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < most
    return i[keep], j[keep], rank[keep]


def _meet_whole(queries: DataFrame, dv: DataFrame, space: Space, most: int, per_cell: int, parts: int) -> DataFrame:
    """(qvid, __rank, vid, ids) by :func:`search_whole`: queries are dealt over ``parts`` groups, each with all vectors."""
    names, key = space.columns, dv.schema["vid"].dataType

    def search(asked: pa.Table, known: pa.Table) -> pa.Table:
        vids = known.column("vid").combine_chunks()
        order = pc.array_sort_indices(vids).to_numpy()      # ties go to the smaller id
        i, j, rank = search_whole(space, _matrix(asked, names), _matrix(known, names)[order], most, per_cell)
        taken = pa.array(order[j])
        return pa.table([asked.column("qvid").combine_chunks().take(pa.array(i)), pa.array(rank), vids.take(taken),
                         known.column("ids").combine_chunks().take(taken)], names=["qvid", "__rank", "vid", "ids"])

    schema = T.StructType([queries.schema["qvid"], T.StructField("__rank", T.DoubleType()), T.StructField("vid", key), dv.schema["ids"]])
    refs = dv.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("qvid"), F.lit(parts)).cast("int"))
    asked, known = (df.repartitionByRange(parts, "part").groupBy("part") for df in (dealt, refs))
    return asked.cogroup(known).applyInArrow(search, schema)


def _coordinate(df: DataFrame, name: str) -> Column:
    """A column of codes as a double."""
    return (F.col(name) if isinstance(df.schema[name].dataType, PLAIN) else F.shiftright(F.xxhash64(name), 11)).cast("double")


def _in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """A stored table in no more partitions than its rows need: each starts a task in Python."""
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def knn(query: DataFrame, ref: DataFrame, qkey: str, rkey: str, features: list[str], k: int,
        metric: str = "euclidean", nominal: list[str] = (), nominal_penalty: float = 0.0,
        self_join: bool = False, per_cell: int = 1024, within: list[str] = (), apart: list[str] = ()) -> DataFrame:
    """k nearest reference rows for every query row, among those that agree with it in
    the (non-null) columns ``within`` and differ from it in each of the columns ``apart``.

    Returns ``qkey, rank (1..k), nkey, dist`` where ``dist`` is the metric
    distance (euclidean: square root of the ranked squared distance).
    Feature columns must be numbers; rows with a null or NaN meet no others.  With ``self_join`` the query
    and reference tables are the same and a row is not its own neighbour.
    """
    ship_package(query.sparkSession)
    nominal, within, apart = list(nominal), list(within), list(apart)
    space = Space(len(features), len(nominal), len(within), len(apart), metric, float(nominal_penalty))
    names = space.columns
    kk = k + 1 if self_join else k

    def rows(df: DataFrame, key: str, out: str) -> DataFrame:
        codes = nominal + within + apart
        made = [F.col(f).cast("double") for f in features] + [_coordinate(df, c) for c in codes]
        known = df.na.drop(subset=[*features, *codes])
        return known.select(F.col(key).alias(out), *[c.alias(n) for c, n in zip(made, names, strict=True)])

    # the query rows are read once (they are needed again to expand the result)
    qrows = cut_lineage(rows(query, qkey, "__qid"))
    refs = qrows.withColumnRenamed("__qid", "__id") if self_join else rows(ref, rkey, "__id")
    dv = cut_lineage(_compress(refs, "__id", names, k + 1).where("vid IS NOT NULL"))
    n_dv = dv.count()
    # distinct query vectors, materialised once and reused by every search
    qv = cut_lineage(qrows.groupBy(*names).agg(F.min("__qid").alias("__q")).select(F.monotonically_increasing_id().alias("qvid"), *names))
    n_qv = qv.count()
    if WHOLE_FROM <= n_dv <= WHOLE_ROWS and n_qv <= WHOLE_QUERIES and not (within or apart):
        parts = max(1, min(math.ceil(n_qv / TASK_ROWS), WHOLE_PAIRS // n_dv))
        vec_nn = _meet_whole(_in_tasks(qv, n_qv), _in_tasks(dv, n_dv), space, kk, per_cell, parts)
    else:
        cells = _Cells(_in_tasks(dv, n_dv), space, n_dv, per_cell)
        seeded = cut_lineage(cells.own(cells.placed(_in_tasks(qv, n_qv)), kk))
        vec_nn = seeded.select("qvid", F.inline("best")).select("qvid", "__rank", "vid", "ids").unionByName(cells.others(seeded, kk))
    nearest = Window.partitionBy("qvid").orderBy("__rank", "vid")
    # k + 1 ids per distinct vector are enough for every row that has it
    first = Window.partitionBy("qvid").orderBy("__rank", "nkey")
    ids = (vec_nn.withColumn("__n", F.row_number().over(nearest)).where(F.col("__n") <= kk)
           .select("qvid", "__rank", F.explode("ids").alias("nkey"))
           .withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= k + 1).drop("__n"))
    qmap = qrows.join(qv, names).select("__qid", "qvid")
    j = qmap.join(ids, "qvid")
    if self_join:
        j = j.where(F.col("nkey") != F.col("__qid"))
    wr = Window.partitionBy("__qid").orderBy("__rank", "nkey")
    out = F.sqrt("__rank") if metric == "euclidean" else F.col("__rank")
    return (j.withColumn("rank", F.row_number().over(wr)).where(F.col("rank") <= k)
            .select(F.col("__qid").alias(qkey), F.col("rank").cast("int").alias("rank"),
                    "nkey", out.alias("dist")))


def knn_classify(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str],
                 k: int = 5, metric: str = "euclidean", weights: str = "uniform") -> DataFrame:
    """M9: majority (or inverse-distance weighted) vote of the k nearest
    training rows; ties go to the lowest label.  Returns ``key, pred, p``
    with ``p`` the vote share of class 1.  With ``distance`` weights a
    neighbour at distance 0 takes all the weight."""
    nn = knn(test, train, key, key, features, k, metric)
    lab = train.select(F.col(key).alias("nkey"), F.col(label).alias("__nl"))
    j = nn.join(lab, "nkey")
    if weights == "distance":
        has_zero = F.min("dist").over(Window.partitionBy(key)) == 0
        wcol = F.when(has_zero, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        wcol = F.lit(1.0)
    votes = (j.withColumn("__w", wcol).groupBy(key, "__nl").agg(F.sum("__w").alias("__v")))
    return (votes.groupBy(key)
            .agg(F.min_by("__nl", F.struct((-F.col("__v")).alias("a"), F.col("__nl").alias("b"))).alias("pred"),
                 (F.sum(F.when(F.col("__nl") == 1, F.col("__v")).otherwise(0.0)) / F.sum("__v")).alias("p")))


def knn_error_curve(train: DataFrame, test: DataFrame, key: str, label: str, features: list[str],
                    k_max: int = 15, metric: str = "euclidean") -> DataFrame:
    """Misclassification rate of the uniform-vote classifier for
    every k = 1..k_max from one neighbour search (votes are running counts
    over the neighbour rank)."""
    nn = knn(test, train, key, key, features, k_max, metric)
    lab = train.select(F.col(key).alias("nkey"), F.col(label).alias("__nl"))
    truth = test.select(key, F.col(label).alias("__y"))
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    runs = (nn.join(lab, "nkey").withColumn("__ones", F.sum("__nl").over(w))
            .withColumn("__pred", (F.col("__ones") > F.col("rank") - F.col("__ones")).cast("int")))
    return (runs.join(truth, key).groupBy(F.col("rank").alias("k"))
            .agg(F.avg((F.col("__pred") != F.col("__y")).cast("int")).alias("error")))


def best_k(curve: DataFrame) -> DataFrame:
    """Smallest k with the lowest error (first minimum)."""
    return curve.agg(F.min_by("k", F.struct("error", "k")).alias("k"), F.min("error").alias("error"))
