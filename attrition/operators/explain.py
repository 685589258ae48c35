"""Feature attribution.

* Linear scores have exact attributions φ_j = w_j (x_j − mean_j) – a
  projection and an unpivot.
* Any fitted MLlib model: sampled Shapley values (Štrumbelj & Kononenko
  2014) as one job.  For row i, permutation p (a hash order of the
  features) and background row b_p, the instance with the first j features
  of the order taken from x_i (the rest from b_p) is scored with and
  without feature j; φ_{i,j} is the mean difference over permutations.
  Rows × permutations × features instances go through ``model.transform``
  in bulk – no Python per row – and Σ_j φ_{i,j} = f(x_i) − mean_p f(b_p).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform


def slope_weights(df: DataFrame, features: list[str], label: str) -> dict[str, float]:
    """A data-derived linear score: univariate least-squares slopes
    w_j = cov(x_j, y) / var(x_j) (one aggregation)."""
    row = df.agg(*[(F.covar_pop(F.col(f).cast("double"), F.col(label).cast("double"))
                    / F.var_pop(F.col(f).cast("double"))).alias(f) for f in features]).first()
    return {f: float(row[f] or 0.0) for f in features}


def linear_attribution(df: DataFrame, key, features: list[str], weights: dict[str, float],
                       means: dict[str, float] | None = None) -> DataFrame:
    """X1 (linear): long table ``key, feature, value, phi``."""
    keys = [key] if isinstance(key, str) else list(key)
    if means is None:
        row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
        means = {f: row[f] for f in features}
    per = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                    (F.lit(weights[f]) * (F.col(f).cast("double") - F.lit(means[f]))).alias("phi"))
           for f in features]
    return df.select(*keys, F.explode(F.array(*per)).alias("a")).select(*keys, "a.*")


def mean_abs_attribution(att: DataFrame) -> DataFrame:
    """Mean |φ| per feature (sort with ``orderBy`` when shown)."""
    return att.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def waterfall(att: DataFrame, key_filter, base: float) -> DataFrame:
    """One row's contributions by |φ| descending with the running total
    from the base value (a handful of rows)."""
    one = att.where(key_filter)
    w = Window.orderBy(F.abs("phi").desc(), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return (one.withColumn("step", F.row_number().over(Window.orderBy(F.abs("phi").desc(), "feature")))
            .withColumn("running", F.lit(base) + F.sum("phi").over(w)))


def attribution_by_value(att: DataFrame, bins: int = 10) -> DataFrame:
    """Mean φ per feature and equal-width bin of the feature's value
    (the data behind a summary plot)."""
    rng = att.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    b = F.when(F.col("mx") == F.col("mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("mn")) * bins / (F.col("mx") - F.col("mn"))), F.lit(bins - 1)))
    # rng has one row per feature (bounded by the feature list)
    return (att.where(F.col("value").isNotNull()).join(F.broadcast(rng), "feature")
            .groupBy("feature", b.cast("int").alias("bin"))
            .agg(F.avg("phi").alias("mean_phi"), F.count(F.lit(1)).alias("n")))


def sampled_shapley(model, rows: DataFrame, background: DataFrame, key: str, features: list[str],
                    n_perm: int = 8, seed: int = 42, score_col: str = "probability") -> DataFrame:
    """X1 (any model): sampled Shapley values ``key, feature, phi, se``, with the
    standard error of each (null for ``n_perm`` 1).

    ``rows`` are the rows to explain (e.g. a D2 sample); ``background`` is a
    table of reference rows, of which ``n_perm`` are picked by hash order."""
    nf = len(features)
    bg = (background.withColumn("__u", hash_uniform(seed, key, F.lit("bg")))
          .orderBy("__u", key).limit(n_perm)
          .withColumn("perm", F.row_number().over(Window.orderBy("__u", key)) - 1)
          .select("perm", *[F.col(f).cast("double").alias(f"b_{f}") for f in features]))
    x = rows.select(key, *[F.col(f).cast("double").alias(f"x_{f}") for f in features])
    inst = (x.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
            .join(F.broadcast(bg), "perm"))                      # n_perm rows, bounded by the argument
    # position of each feature in this (row, permutation)'s random order
    keys = [F.struct(hash_uniform(seed, key, "perm", F.lit(f)).alias("u"), F.lit(i).alias("f"))
            for i, f in enumerate(features)]
    inst = inst.withColumn("__order", F.transform(F.array_sort(F.array(*keys)), lambda s: s["f"]))
    inst = inst.select("*", F.explode(F.sequence(F.lit(0), F.lit(nf - 1))).alias("j"))
    inst = inst.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("with_j"))
    # feature i is taken from x when its position < j (+ 1 when with_j)
    cols = []
    for i, f in enumerate(features):
        pos = F.array_position(F.col("__order"), F.lit(i)) - 1
        take_x = pos < (F.col("j") + F.col("with_j"))
        cols.append(F.when(take_x, F.col(f"x_{f}")).otherwise(F.col(f"b_{f}")).alias(f))
    mixed = inst.select(key, "perm", "j", "with_j", F.element_at("__order", F.col("j") + 1).alias("fi"), *cols)
    scored = model.transform(mixed)
    p = vector_to_array(score_col)[1] if score_col == "probability" else F.col(score_col)
    s = scored.select(key, "perm", "fi", "with_j", p.alias("f"))
    diff = (s.groupBy(key, "perm", "fi")
            .agg((F.sum(F.when(F.col("with_j") == 1, F.col("f")))
                  - F.sum(F.when(F.col("with_j") == 0, F.col("f")))).alias("d")))
    names = F.array(*[F.lit(f) for f in features])
    se = F.stddev_samp("d") / F.sqrt(F.count("d"))
    return (diff.groupBy(key, "fi").agg(F.avg("d").alias("phi"), se.alias("se"))
            .select(key, F.element_at(names, F.col("fi") + 1).alias("feature"), "phi", "se"))
