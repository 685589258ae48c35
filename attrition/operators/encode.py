"""Encoding and scaling fitted on training rows only.

Fitted state is small (levels of a nominal column, one min/max or mean/std
per column) and is captured as literals in column expressions, or as MLlib
pipeline stages (``StringIndexer``, ``OneHotEncoder``, ``SQLTransformer``)
so a fitted pipeline can be persisted and applied to new or streaming data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform

MAX_LEVELS = 10_000


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """Sorted distinct non-null values; refuses unbounded cardinality."""
    vals = (df.select(col).where(F.col(col).isNotNull()).distinct()
            .limit(max_levels + 1).collect())
    if len(vals) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels; use a hashed or vector encoding")
    return sorted(v[0] for v in vals)


# --- E1 label encoding ------------------------------------------------------

def label_encoder(cols: list[str], suffix: str = "_en") -> Pipeline:
    """StringIndexer per column, alphabetical codes 0..n-1, unseen → error."""
    return Pipeline(stages=[
        StringIndexer(inputCol=c, outputCol=f"{c}{suffix}__d", stringOrderType="alphabetAsc",
                      handleInvalid="error") for c in cols])


def label_encode(train: DataFrame, cols: list[str], apply_to: DataFrame | None = None,
                 suffix: str = "_en") -> DataFrame:
    """Fit on ``train`` and add integer codes ``<col><suffix>`` to ``apply_to``."""
    model = label_encoder(cols, suffix).fit(train)
    out = model.transform(apply_to if apply_to is not None else train)
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}__d").cast("int")).drop(f"{c}{suffix}__d")
    return out


# --- E2/E3 one-hot ------------------------------------------------------------

@dataclass
class OneHot:
    col: str
    values: list
    as_bool: bool = False

    def names(self) -> list[str]:
        return [f"{self.col}_{v}" for v in self.values]

    def exprs(self) -> list[Column]:
        out = []
        for v, name in zip(self.values, self.names()):
            e = F.col(self.col) == F.lit(v)
            out.append((e if self.as_bool else e.cast("int")).alias(name))
        return out

    def transform(self, df: DataFrame, drop: bool = True) -> DataFrame:
        keep = [c for c in df.columns if not (drop and c == self.col)]
        return df.select(*keep, *self.exprs())


def fit_one_hot(train: DataFrame, col: str, as_bool: bool = False) -> OneHot:
    """All levels kept; an unseen value at transform gives all zeros."""
    return OneHot(col, levels(train, col), as_bool)


def dummies(df: DataFrame, col: str) -> DataFrame:
    """Boolean indicator per level of this same table."""
    return fit_one_hot(df, col, as_bool=True).transform(df)


# --- E5/E6 scaling ------------------------------------------------------------

@dataclass
class Scaler:
    kind: str                       # "minmax" or "standard"
    params: dict                    # col -> (offset, scale)

    def expr(self, c: str) -> Column:
        off, scale = self.params[c]
        if scale == 0 or scale is None:
            return F.lit(0.0).alias(c) if off is not None else F.lit(None).cast("double").alias(c)
        return ((F.col(c).cast("double") - F.lit(off)) / F.lit(scale)).alias(c)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expr(c) if c in self.params else F.col(c) for c in df.columns])

    def as_stage(self) -> SQLTransformer:
        """The fitted scaler as a persistable pipeline stage."""
        parts = []
        for c, (off, scale) in self.params.items():
            if not scale:
                parts.append(f"CAST(0.0 AS DOUBLE) AS `{c}__s`")
            else:
                parts.append(f"(CAST(`{c}` AS DOUBLE) - {off!r}D) / {scale!r}D AS `{c}__s`")
        return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_minmax(train: DataFrame, cols: list[str]) -> Scaler:
    """E5: (x − min) / (max − min) from one aggregation over training rows;
    a constant column maps to 0; test values may leave [0, 1]."""
    row = train.agg(*[F.min(F.col(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(cols)],
                    *[F.max(F.col(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    return Scaler("minmax", {c: (row[f"mn{i}"], (row[f"mx{i}"] - row[f"mn{i}"])
                                 if row[f"mn{i}"] is not None else None)
                             for i, c in enumerate(cols)})


def fit_standard(train: DataFrame, cols: list[str]) -> Scaler:
    """(x − mean) / population std; a constant column maps to 0."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return Scaler("standard", {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)})


# --- E4 fit on train, apply to others ------------------------------------------

@dataclass
class Prep:
    """Label codes, one-hot levels and a scaler, all fitted on training rows."""
    label_model: PipelineModel | None
    label_cols: list[str]
    one_hots: list[OneHot]
    scaler: Scaler | None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        if self.label_model is not None:
            out = self.label_model.transform(out)
            for c in self.label_cols:
                out = out.withColumn(c, F.col(f"{c}_en__d").cast("int")).drop(f"{c}_en__d")
        for oh in self.one_hots:
            out = oh.transform(out)
        if self.scaler is not None:
            out = self.scaler.transform(out)
        return out


def fit_prep(train: DataFrame, label_cols: list[str] = (), one_hot_cols: list[str] = (),
             scale_cols: list[str] = (), scale: str = "minmax") -> Prep:
    label_model = label_encoder(list(label_cols)).fit(train) if label_cols else None
    ohs = [fit_one_hot(train, c) for c in one_hot_cols]
    scaler = None
    if scale_cols:
        scaler = (fit_minmax if scale == "minmax" else fit_standard)(train, list(scale_cols))
    return Prep(label_model, list(label_cols), ohs, scaler)


ROWS_PER_BUCKET = 1_000_000


def ordered_target_stats(df: DataFrame, key, label: str, nominal: list[str], prior_weight: float = 1.0, seed: int = 42,
                         buckets: int | None = None) -> DataFrame:
    """M7: each nominal column ``c`` gets ``c__ts``, the mean label of the rows of its
    level that come before it in a hash order of the keys, drawn to the overall mean
    ``p``: (Σ labels before + prior_weight · p) / (rows before + prior_weight).  No row
    sees its own label.

    The order is cut into buckets of about ``ROWS_PER_BUCKET`` rows.  Sums before a row
    are those of the level's earlier buckets (one row per level and bucket) and a window
    inside (level, bucket), so a level that holds a third of all rows is no hot group.
    A null is a level of its own; a null label counts neither as a row nor in the sums."""
    keys = [key] if isinstance(key, str) else list(key)
    if buckets is None:
        buckets = max(1, math.ceil(df.count() / ROWS_PER_BUCKET))
    prior = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    out = df.withColumn("__u", hash_uniform(seed, *keys, F.lit("order"))).withColumn("__b", F.floor(F.col("__u") * buckets))
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    one = F.col(label).isNotNull().cast("long")
    for c in nominal:
        earlier = Window.partitionBy(c).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0)
        totals = (out.groupBy(c, "__b").agg(F.sum(y).alias("__s"), F.sum(one).alias("__n"))
                  .select(F.col(c).alias("__level"), F.col("__b").alias("__bucket"), F.coalesce(F.sum("__s").over(earlier), zero).alias("__s0"),
                          F.coalesce(F.sum("__n").over(earlier), zero).alias("__n0")))
        within = Window.partitionBy(c, "__b").orderBy("__u", *keys).rowsBetween(Window.unboundedPreceding, -1)
        inside = out.withColumn("__s1", F.coalesce(F.sum(y).over(within), zero)).withColumn("__n1", F.coalesce(F.sum(one).over(within), zero))
        both = inside.join(totals, F.col(c).eqNullSafe(F.col("__level")) & (F.col("__b") == F.col("__bucket")))
        value = (F.col("__s0") + F.col("__s1") + F.lit(prior_weight) * F.lit(prior)) / (F.col("__n0") + F.col("__n1") + F.lit(prior_weight))
        out = both.withColumn(f"{c}__ts", value).drop("__s0", "__n0", "__s1", "__n1", "__level", "__bucket")
    return out.drop("__u", "__b")


def target_stats(df: DataFrame, label: str, nominal: str, prior_weight: float = 1.0) -> DataFrame:
    """(level, stat) over all training rows: what rows to be scored are encoded by.  A
    level that training never saw is the overall mean, the caller's ``coalesce``."""
    prior = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return df.groupBy(nominal).agg(((F.sum(F.col(label).cast("double")) + F.lit(prior_weight) * F.lit(prior))
                                    / (F.count(label) + F.lit(prior_weight))).alias(f"{nominal}__ts"))
