"""Minority oversampling (R1–R3) and the union with the originals.

Each synthetic row is ``x + u · (neighbour − x)`` for a minority row ``x``,
one of its k nearest minority neighbours and a gap ``u`` in [0, 1).  Which
row, which neighbour and which gap are pure functions of ``(seed, key,
copy)``, so the result is reproducible and survives recomputation.  Every
minority row makes ⌊need/m⌋ copies and the ``need mod m`` rows first in
hash order make one more (exact count, distributed ranking).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform
from attrition.operators.neighbors import knn
from attrition.operators.ordinal import dense_index
from attrition.session import cut_lineage

#: Rows of a partition of the copies' order, where the minority is large.
ORDER_ROWS, MANY_ROWS = 1 << 14, 1 << 16


def smote_need(n_minority: int, n_majority: int, ratio: float | None = None) -> int:
    """Rows to add: to balance (ratio None) or to reach ``ratio · n_majority``."""
    target = n_majority if ratio is None else int(ratio * n_majority)
    return max(0, target - n_minority)


def nominal_penalty(minority: DataFrame, features: list[str]) -> float:
    """SMOTE-NC: squared median of the minority class's feature std devs
    (population)."""
    row = minority.agg(*[F.stddev_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    stds = sorted(row[f] for f in features if row[f] is not None)
    if not stds:
        return 0.0
    n = len(stds)
    med = stds[n // 2] if n % 2 else (stds[n // 2 - 1] + stds[n // 2]) / 2
    return med * med


def smote(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, seed: int = 42,
          minority: int = 1, ratio: float | None = None, nominal: list[str] = ()) -> DataFrame:
    """R1/R2/R3 + U1: originals plus synthetic minority rows.

    Output columns: ``key, syn_idx (null for originals), is_synthetic,
    features…, nominal…, label``.
    """
    nominal = list(nominal)
    cols = list(features) + nominal
    base = df.select(key, *cols, label)
    # the search reads the minority several times; the other rows only pass through
    minor = cut_lineage(base.where(F.col(label) == minority))
    counts = {r[0]: r[1] for r in base.groupBy(label).count().collect()}
    m = counts.get(minority, 0)
    n_major = max((n for lab, n in counts.items() if lab != minority), default=0)
    need = smote_need(m, n_major, ratio)
    orig = base.select(key, F.lit(None).cast("int").alias("syn_idx"), F.lit(0).alias("is_synthetic"),
                       *cols, label)
    if need == 0:
        return orig
    if m < k + 1:
        raise ValueError(f"minority class has {m} rows; at least k + 1 = {k + 1} are needed")
    penalty = nominal_penalty(minor, list(features)) if nominal else 0.0
    per, extra = divmod(need, m)
    order = dense_index(minor.select(key, hash_uniform(seed, key, F.lit("order")).alias("__u")), ["__u", key], "__ord",
                        m // ORDER_ROWS if m >= MANY_ROWS else None)
    ordered = minor.join(order.drop("__u"), key)
    reps = F.lit(per) + (F.col("__ord") < extra).cast("int")
    copies = (ordered.where(reps > 0)
              .select(key, *[F.col(c).alias(f"x_{c}") for c in cols],
                      F.explode(F.sequence(F.lit(0), reps - 1)).alias("syn_idx")))
    copies = (copies
              .withColumn("rank", (F.floor(hash_uniform(seed, key, "syn_idx", F.lit("nn")) * k) + 1).cast("int"))
              .withColumn("__gap", hash_uniform(seed, key, "syn_idx", F.lit("gap"))))
    nn = knn(minor, minor, key, key, list(features), k, nominal=nominal, nominal_penalty=penalty,
             self_join=True)
    nfeat = minor.select(F.col(key).alias("nkey"), *[F.col(c).alias(f"n_{c}") for c in cols])
    j = copies.join(nn.select(key, "rank", "nkey"), [key, "rank"]).join(nfeat, "nkey")
    new_vals = [(F.col(f"x_{f}") + F.col("__gap") * (F.col(f"n_{f}") - F.col(f"x_{f}"))).alias(f)
                for f in features]
    syn = j.select(key, "syn_idx", *new_vals)
    if nominal:
        votes = (nn.join(nfeat, "nkey")
                 .select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n_{c}").cast("string")
                                                           .alias("v")) for c in nominal])).alias("__nv"))
                 .groupBy(key, "__nv.c", "__nv.v").agg(F.count(F.lit(1)).alias("__cnt")))
        mode = (votes.groupBy(key, "c")
                .agg(F.min_by("v", F.struct((-F.col("__cnt")).alias("a"), F.col("v").alias("b"))).alias("v"))
                .groupBy(key).pivot("c", nominal).agg(F.first("v")))
        types = dict(df.dtypes)
        syn = syn.join(mode.select(key, *[F.col(c).cast(types[c]).alias(c) for c in nominal]), key)
    syn = syn.select(key, F.col("syn_idx").cast("int"), F.lit(1).alias("is_synthetic"), *cols,
                     F.lit(minority).cast(dict(df.dtypes)[label]).alias(label))
    return orig.unionByName(syn)
