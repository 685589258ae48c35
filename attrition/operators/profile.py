"""Distribution and correlation profiles.

Each function returns plot-ready data as a DataFrame; figures are not drawn.
Multi-column profiles unpivot first so that all columns go through one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.functions.hashing import TWO_32, hash_text
from attrition.operators.quantiles import exact_percentiles, grouped_percentiles
from attrition.session import cut_lineage, ship_package


def _long(df: DataFrame, cols: list[str], ids: list[str] | None = None,
          value_type: str = "double") -> DataFrame:
    """Unpivot ``cols`` to ``(ids…, column, value)``."""
    ids = ids or []
    return df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols]).unpivot(
        ids, cols, "column", "value")


def column_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: ``column, mn, mx, n`` (one aggregation job)."""
    return (_long(df, cols).where(F.col("value").isNotNull())
            .groupBy("column").agg(F.min("value").alias("mn"), F.max("value").alias("mx"),
                                   F.count(F.lit(1)).alias("n")))


def histograms(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """A1: equal-width histograms over [min, max] with the last bin closed.

    Output ``column, bin, lo, hi, n``; empty bins are present with n = 0.
    Two passes: one aggregation for the ranges (one row per column to the
    driver), one for the counts of all columns together."""
    rng = {r["column"]: (r["mn"], r["mx"]) for r in column_ranges(df, cols).collect()}
    cols = [c for c in cols if c in rng]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, bin int, lo double, hi double, n bigint")
    mn = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(rng[c][0]))]), F.col("column"))
    mx = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(rng[c][1]))]), F.col("column"))
    b = F.when(mx == mn, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - mn) * bins / (mx - mn)), F.lit(bins - 1))).cast("int")
    counts = (_long(df, cols).where(F.col("value").isNotNull())
              .groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    # the full grid (columns × bins, fixed by the arguments) keeps empty bins
    grid = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("bin"),
                     F.lit(rng[c][0] + i * ((rng[c][1] - rng[c][0]) / bins)).alias("lo"),
                     F.lit(rng[c][0] + (i + 1) * ((rng[c][1] - rng[c][0]) / bins)).alias("hi"))
            for c in cols for i in range(bins)]
    cells = counts.groupBy().agg(F.lit(1).alias("__one")).select(F.explode(F.array(*grid)).alias("g")).select("g.*")
    return (cells.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "lo", "hi", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def kde_grid(df: DataFrame, col: str, grid: int = 200, scale_bins: int | None = None,
             method: str = "exact", prebins: int = 4096) -> DataFrame:
    """A2: Gaussian kernel density on ``grid`` points spanning [min, max],
    Scott bandwidth ``n^(-1/5) · std`` (sample std).  With ``scale_bins`` the
    density is scaled by ``n · binwidth`` as in a histogram overlay.

    ``exact``: rows are counted by value, and each distinct value contributes to
    every grid point (values × grid; the sums are combined map-side).
    ``binned``, for continuous columns: rows are first counted into
    ``prebins`` fine bins (one aggregation), then each bin contributes at its
    mean, so the kernel work is prebins × grid whatever the row count (error
    bounded by the fine-bin width relative to the bandwidth).
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    st = x.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n"),
               F.stddev_samp("x").alias("sd"))
    stats = st.select(F.struct("mn", "mx", "n", "sd")).scalar()
    mn, mx, n, sd = stats["mn"], stats["mx"], stats["n"], stats["sd"]
    h = sd * F.pow(n, -0.2)
    g = F.col("i")
    point = mn + (mx - mn) * g / (grid - 1)
    if method == "binned":
        fb = F.when(mx == mn, F.lit(0)).otherwise(
            F.least(F.floor((F.col("x") - mn) * prebins / (mx - mn)), F.lit(prebins - 1)))
        pts = x.groupBy(fb.alias("fb")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("w"))
    else:
        pts = x.groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    contrib = F.col("w") * F.exp(-0.5 * F.pow((point - F.col("x")) / h, 2))
    dens = (pts.select("x", "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
            .groupBy("i").agg(F.sum(contrib).alias("s")))
    out = dens.select(F.col("i").cast("int").alias("i"), point.alias("x"),
                      (F.col("s") / (n * h * math.sqrt(2 * math.pi))).alias("density"))
    if scale_bins:
        out = out.withColumn("density", F.col("density") * n * (mx - mn) / scale_bins)
    return out


def qcut_edges(df: DataFrame, col: str, q: int = 10) -> list[float]:
    """A3: quantile edges at 0, 1/q, …, 1 (exact, linear interpolation),
    duplicates dropped."""
    edges = exact_percentiles(df, col, [i / q for i in range(q + 1)])
    if edges[0] is None:
        return []
    return sorted(set(edges))


def qcut(df: DataFrame, col: str, q: int = 10, out: str = "bin") -> DataFrame:
    """A3: adds ``bin`` (0-based), ``bin_lo``, ``bin_hi``: right-closed bins,
    lowest edge included; null values get a null bin."""
    edges = qcut_edges(df, col, q)
    inner = F.array(*[F.lit(e) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    x = F.col(col).cast("double")
    idx = F.size(F.filter(inner, lambda e: e < x))
    all_edges = F.array(*[F.lit(e) for e in edges])
    b = F.when(x.isNull() | (len(edges) < 2), F.lit(None)).otherwise(idx).cast("int")
    return (df.withColumn(out, b)
            .withColumn(f"{out}_lo", F.element_at(all_edges, F.col(out) + 1))
            .withColumn(f"{out}_hi", F.element_at(all_edges, F.col(out) + 2)))


def class_distribution(df: DataFrame, col: str, label: str, q: int = 10) -> DataFrame:
    """A4: rows per quantile bin and label value (0/1), zeros filled, plus
    the positive share per bin."""
    binned = qcut(df.select(col, label), col, q).where(F.col("bin").isNotNull())
    counts = (binned.groupBy("bin", "bin_lo", "bin_hi")
              .agg(F.count_if(F.col(label) == 0).alias("n_0"),
                   F.count_if(F.col(label) == 1).alias("n_1")))
    return counts.withColumn("rate", F.col("n_1") / (F.col("n_0") + F.col("n_1")))


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: ``column, value, n`` for several nominal columns in one job."""
    return (_long(df, cols, value_type="string")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def label_share(df: DataFrame, label: str) -> DataFrame:
    """Label counts and their share of all rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the aggregated table (one row per class)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of numeric columns."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A10: Pearson correlation for every ordered pair of numeric columns,
    pairwise complete; one aggregation job.  Output ``a, b, corr``."""
    cols = cols or numeric_columns(df)
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_{j}")
            for (i, a), (j, b) in combinations(enumerate(cols), 2)]
    wide = df.agg(*aggs) if aggs else df.limit(0)
    pairs = []
    for (i, a), (j, b) in combinations(enumerate(cols), 2):
        pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_{j}").alias("corr")))
        pairs.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{i}_{j}").alias("corr")))
    diag = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in cols]
    return wide.select(F.explode(F.array(*(pairs + diag))).alias("p")).select("p.*")


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Quartiles (exact), 1.5·IQR fences, whisker ends (extreme values
    inside the fences) and outlier count per group."""
    q = grouped_percentiles(df, col, [0.25, 0.5, 0.75], group)
    spark = df.sparkSession
    gtype = df.schema[group].dataType.simpleString()
    quart = spark.createDataFrame([(g, *v) for g, v in q.items()],
                                  f"g {gtype}, q1 double, median double, q3 double")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    x = F.col(col).cast("double")
    inside = (x >= lo_f) & (x <= hi_f)
    return (df.where(x.isNotNull()).join(quart, F.col(group) == F.col("g"))
            .groupBy(group, "q1", "median", "q3")
            .agg(F.min(F.when(inside, x)).alias("whisker_lo"),
                 F.max(F.when(inside, x)).alias("whisker_hi"),
                 F.count_if(~inside).alias("n_outliers"),
                 F.count(F.lit(1)).alias("n")))


def group_mean_ci(df: DataFrame, group: str, col: str, z: float = 1.96) -> DataFrame:
    """Group mean with a normal-approximation 95 % interval."""
    x = F.col(col).cast("double")
    m = (df.groupBy(group).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
                               F.count(x).alias("n")))
    half = z * F.col("sd") / F.sqrt("n")
    return m.select(group, "mean", "n", (F.col("mean") - half).alias("ci_lo"),
                    (F.col("mean") + half).alias("ci_hi"))


#: Poisson(1): the chance of at most 0, 1, 2, … draws (beyond the last: one more).
POISSON_CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)) for n in range(13)]


#: Rows whose replicates one task draws, rows drawn at once, and groups whose sums it holds.
BOOT_ROWS, BOOT_BLOCK, BOOT_GROUPS = 1 << 14, 256, 1000


def _replicates(n_boot: int):
    """Rows (text, group, x) to (group, r, number and sum of what replicate r takes)."""
    ends = [f"|{q}".encode() for q in range((n_boot + 3) // 4)]
    least = np.array(POISSON_CDF) * TWO_32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[object, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for g, (n, s) in totals.items():
                r = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(r), kind), pa.array(r, pa.int32()), pa.array(n[r]), pa.array(s[r])], names=["__group", "__r", "__n", "__s"])
            totals.clear()

        for batch in batches:
            kind = batch.column("__group").type
            for at in range(0, batch.num_rows, BOOT_BLOCK):
                part = batch.slice(at, BOOT_BLOCK)
                texts = [t.encode() for t in part.column("__text").to_pylist()]
                drawn = b"".join([md5(t + end).digest() for t in texts for end in ends])
                u = np.frombuffer(drawn, ">u4").astype(float).reshape(len(texts), -1)[:, :n_boot]
                times = np.searchsorted(least, u, side="right").astype(float)
                x = part.column("__x").to_numpy()
                groups = part.column("__group").to_pylist()
                for g in set(groups):
                    own = np.array([h == g or h is g for h in groups])
                    n, s = totals.setdefault(g, np.zeros((2, n_boot)))
                    n += times[own].sum(axis=0)
                    taken, values = times[own], x[own]
                    s += np.where(taken > 0, taken * values[:, None], 0.0).sum(axis=0)
                if len(totals) > BOOT_GROUPS:
                    yield from flush()
        yield from flush()

    return run


def bootstrap_mean_ci(df: DataFrame, key: str, group: str, col: str, n_boot: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Group mean with a percentile bootstrap interval.

    Replicate ``r`` takes a row Poisson(1) times; the count is read from the hash of
    (seed, key, r), four replicates a hash.  A task draws all replicates of a row at once
    and adds them up, so one pass makes all replicates and no row is repeated: groups ×
    ``n_boot`` rows a task are shuffled.  Null values are left out; a replicate that takes
    no row of a group has no mean there."""
    rows = cut_lineage(df.select(hash_text(seed, key).alias("__text"), F.col(group).alias("__group"), F.col(col).cast("double").alias("__x")).where(F.col("__x").isNotNull()))
    dealt = rows.repartition(max(1, math.ceil(rows.count() / BOOT_ROWS)))
    schema = T.StructType([rows.schema["__group"], T.StructField("__r", T.IntegerType()), T.StructField("__n", T.DoubleType()), T.StructField("__s", T.DoubleType())])
    ship_package(df.sparkSession)
    sums = (dealt.mapInArrow(_replicates(n_boot), schema).groupBy("__group", "__r")
            .agg((F.sum("__s") / F.sum("__n")).alias("__mean")))
    ends = sums.groupBy("__group").agg(*[F.percentile("__mean", F.lit(p)).alias(n)
                                         for n, p in (("ci_lo", (1 - level) / 2), ("ci_hi", (1 + level) / 2))],
                                       F.count(F.lit(1)).alias("n_boot"))
    means = rows.groupBy("__group").agg(F.avg("__x").alias("mean"), F.count(F.lit(1)).alias("n"))
    return (means.join(ends.withColumnRenamed("__group", "__g"), F.col("__group").eqNullSafe(F.col("__g")), "left")
            .select(F.col("__group").alias(group), "mean", "n", "ci_lo", "ci_hi", "n_boot"))


def pair_bins(df: DataFrame, cols: list[str], bins: int = 10, hue: str | None = None) -> DataFrame:
    """2-D equal-width bin counts for every pair of columns (optionally
    per hue value): the data behind a scatter-matrix, with bounded size."""
    rng = df.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in cols],
                 *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in cols]).first()

    def bin_of(c: str) -> Column:
        mn, mx = rng[f"mn_{c}"], rng[f"mx_{c}"]
        if mn is None or mx == mn:
            return F.lit(0)
        return F.least(F.floor((F.col(c).cast("double") - mn) * bins / (mx - mn)), F.lit(bins - 1)).cast("int")

    pairs = [F.struct(F.lit(a).alias("x_col"), F.lit(b).alias("y_col"),
                      bin_of(a).alias("x_bin"), bin_of(b).alias("y_bin"))
             for a, b in combinations(cols, 2)]
    keep = [F.col(c).isNotNull() for c in cols]
    cond = keep[0]
    for k in keep[1:]:
        cond = cond & k
    hue_cols = [hue] if hue else []
    return (df.where(cond).select(*hue_cols, F.explode(F.array(*pairs)).alias("p"))
            .groupBy(*hue_cols, "p.x_col", "p.y_col", "p.x_bin", "p.y_bin")
            .agg(F.count(F.lit(1)).alias("n")))


def scatter3_counts(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """Counts per distinct (x, y, z, group) point."""
    return df.groupBy(*cols, group).agg(F.count(F.lit(1)).alias("n"))


def fold_summary(scores: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population std over fold scores, with ±2·std band."""
    return (scores.groupBy(*by)
            .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                 F.count(F.lit(1)).alias("n_folds"))
            .withColumn("lo", F.col("mean") - 2 * F.col("std"))
            .withColumn("hi", F.col("mean") + 2 * F.col("std")))
