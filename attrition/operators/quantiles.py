"""Exact quantiles and ranks without funnelling a column through one task.

Spark's exact ``percentile`` aggregate merges every distinct value of a group
into one buffer; at cluster scale that is one task holding a whole column (or
a whole hot group).  Here an exact order statistic is found in a few bounded
passes over (group, distinct value, count), so a value that half of all rows
share is one row:

1. ``percentile_approx`` gives ~``bins`` global equi-depth edges (a sketch);
2. one aggregation counts rows, values and min/max per (group, bucket);
3. buckets holding a wanted rank are either constant (done), or small enough
   to be sorted inside their own window partition; larger ones recurse on
   finer edges, which the distinct values always allow.

Only bucket statistics (≤ groups × bins rows) ever reach the driver, so the
number of groups must be modest (classes, clusters, columns).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions.buckets import bucketize

#: Distinct values that one window partition may sort.
SMALL_BUCKET = 2_000_000


def _bucketize(x: DataFrame, bins: int) -> DataFrame:
    probs = [i / bins for i in range(1, bins)]
    approx = x.agg(F.percentile_approx("x", probs, 8 * bins).alias("e")).first()["e"]
    return bucketize(x, "x", approx or [], "b")


def _pair_filter(pairs) -> Column:
    """The value whose rows hold a wanted place: ``before`` ≤ place < ``before`` + ``c``."""
    cond = F.lit(False)
    for g, b, local in pairs:
        cond = cond | (F.col("g").eqNullSafe(F.lit(g)) & (F.col("b") == F.lit(float(b)))
                       & (F.col("before") <= F.lit(local)) & (F.lit(local) < F.col("before") + F.col("c")))
    return cond


def _select(xb: DataFrame, stats: list, want: dict, bins: int) -> dict:
    """``want``: {group: [ranks]} → {(group, rank): value}."""
    per_group: dict = {}
    for r in stats:
        per_group.setdefault(r["g"], []).append(r)
    out: dict = {}
    todo: dict = {}
    for g, ranks in want.items():
        buckets = sorted(per_group.get(g, []), key=lambda r: r["b"])
        start = 0
        spans = []
        for r in buckets:
            spans.append((start, start + r["n"], r))
            start += r["n"]
        for rank in ranks:
            for lo, hi, r in spans:
                if lo <= rank < hi:
                    if r["lo"] == r["hi"]:
                        out[(g, rank)] = r["lo"]
                    else:
                        todo.setdefault((g, r["b"], r["values"]), []).append((rank, rank - lo))
                    break
    small = {k: v for k, v in todo.items() if k[2] <= SMALL_BUCKET}
    if small:
        pairs = [(g, b, local) for (g, b, _), v in small.items() for _, local in v]
        gb = F.lit(False)
        for g, b, _ in small:
            gb = gb | (F.col("g").eqNullSafe(F.lit(g)) & (F.col("b") == F.lit(float(b))))
        w = Window.partitionBy("g", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        picked = (xb.where(gb)
                  .withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
                  .where(_pair_filter(pairs))
                  .select("g", "b", "before", "c", "x").collect())
        for (g, b, _), v in small.items():
            for rank, local in v:
                out[(g, rank)] = next(p["x"] for p in picked if p["g"] == g and p["b"] == float(b)
                                      and p["before"] <= local < p["before"] + p["c"])
    for (g, b, n), v in todo.items():
        if (g, b, n) in small:
            continue
        sub = xb.where(F.col("g").eqNullSafe(F.lit(g)) & (F.col("b") == F.lit(float(b)))).select("g", "x", "c")
        sub_b = _bucketize(sub, bins)
        sub_stats = _stats(sub_b)
        local = _select(sub_b, sub_stats, {g: [l for _, l in v]}, bins)
        for rank, l in v:
            out[(g, rank)] = local[(g, l)]
    return out


def _stats(xb: DataFrame) -> list:
    return (xb.groupBy("g", "b")
            .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect())


def grouped_percentiles(df: DataFrame, col: str | Column, probs: list[float],
                        group: str | Column | None = None, bins: int = 512) -> dict:
    """Exact linear-interpolated percentiles (numpy / pandas default) of
    ``col`` per group.  Nulls and NaN are ignored.

    Returns ``{group_value: [value per prob]}`` (``None`` key when ungrouped).
    """
    c = F.col(col) if isinstance(col, str) else col
    g = F.lit(None).cast("string") if group is None else (F.col(group) if isinstance(group, str) else group)
    x = (df.select(g.alias("g"), c.cast("double").alias("x"))
         .where(F.col("x").isNotNull() & ~F.isnan("x"))
         .groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
         .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        xb = _bucketize(x, bins)
        stats = _stats(xb)
        sizes: dict = {}
        for r in stats:
            sizes[r["g"]] = sizes.get(r["g"], 0) + r["n"]
        want = {}
        for g_val, n in sizes.items():
            pos = [p * (n - 1) for p in probs]
            want[g_val] = sorted({math.floor(p) for p in pos} | {math.ceil(p) for p in pos})
        vals = _select(xb, stats, want, bins)
    finally:
        x.unpersist()
    res = {}
    for g_val, n in sizes.items():
        row = []
        for p in probs:
            pos = p * (n - 1)
            lo, hi = vals[(g_val, math.floor(pos))], vals[(g_val, math.ceil(pos))]
            row.append(lo + (hi - lo) * (pos - math.floor(pos)))
        res[g_val] = row
    return res


def exact_percentiles(df: DataFrame, col: str | Column, probs: list[float],
                      bins: int = 512) -> list[float | None]:
    """Exact percentiles of one column; ``None`` for an empty column."""
    res = grouped_percentiles(df, col, probs, None, bins)
    return res.get(None, [None] * len(probs))
