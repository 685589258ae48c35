"""Deterministic splits, samples and folds.

Train/test membership is a column, not two copies of the table.  The default
(hash) mode is a narrow projection: no shuffle, and the same rows land in the
same split after any recomputation.  Exact mode reaches precise per-class
quotas through a distributed global order (never a window over a whole
class, which would put most rows in one task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.hashing import hash_uniform
from attrition.operators.ordinal import dense_index


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def split_hash(df: DataFrame, key, test_frac: float = 0.3, seed: int = 42,
               out: str = "split") -> DataFrame:
    """D1 (default): ``test`` when hash-uniform(seed, key) < test_frac."""
    u = hash_uniform(seed, *_keys(key))
    return df.withColumn(out, F.when(u < test_frac, F.lit("test")).otherwise(F.lit("train")))


def _u(seed: int, keys: list[str], tag: str | None) -> Column:
    """The row's uniform draw; ``tag`` makes folds and samples independent
    of a split drawn with the same seed."""
    return hash_uniform(seed, *keys) if not tag else hash_uniform(seed, *keys, F.lit(tag))


def class_rank(df: DataFrame, key, label: str, seed: int = 42, out: str = "class_rank",
               tag: str | None = None) -> DataFrame:
    """keys, ``__label``, ``__u``, 0-based rank of each row inside its class
    by (hash, key), and the class size.  Null labels are a class of their own.

    One distributed global order over these narrow columns; the class offset
    is subtracted using the class counts (one row per class)."""
    keys = _keys(key)
    narrow = df.select(*keys, F.col(label).alias("__label"), _u(seed, keys, tag).alias("__u"))
    idx = dense_index(narrow, ["__label", "__u", *keys], "__idx")
    # nulls sort first, as in the global order
    counts = sorted(((r[0], r[1]) for r in idx.groupBy("__label").count().collect()),
                    key=lambda c: (c[0] is not None, 0 if c[0] is None else c[0]))
    offset, total, acc = F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), 0
    for lab, n in counts:
        same = F.col("__label").eqNullSafe(F.lit(lab))
        offset, total = F.when(same, F.lit(acc)).otherwise(offset), F.when(same, F.lit(n)).otherwise(total)
        acc += n
    return idx.withColumn(out, F.col("__idx") - offset).withColumn("__class_n", total).drop("__idx")


def split_exact(df: DataFrame, key, label: str, test_frac: float = 0.3, seed: int = 42,
                out: str = "split") -> DataFrame:
    """D1 (exact, stratified): the first ceil(test_frac · n_class) rows of
    each class in (hash, key) order are ``test``; null labels are a class.

    Only the last test row of each class is looked up; the split itself is a
    comparison with it, so the table is neither copied nor joined."""
    keys = _keys(key)
    r = class_rank(df, key, label, seed)
    last = r.where(F.col("class_rank") == F.ceil(F.lit(test_frac) * F.col("__class_n")) - 1).collect()
    place = F.struct(_u(seed, keys, None).alias("u"), *[F.col(k) for k in keys])
    types = dict(df.dtypes)
    test = F.lit(False)
    for row in last:
        bound = F.struct(F.lit(row["__u"]).alias("u"), *[F.lit(row[k]).cast(types[k]).alias(k) for k in keys])
        test = test | (F.col(label).eqNullSafe(F.lit(row["__label"])) & (place <= bound))
    return df.withColumn(out, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def sample_n(df: DataFrame, key, n: int = 500, seed: int = 42) -> DataFrame:
    """N rows with the smallest hash (a top-n, bounded per partition)."""
    keys = _keys(key)
    return (df.withColumn("__u", _u(seed, keys, "sample"))
            .orderBy("__u", *keys).limit(n).drop("__u"))


def kfold_hash(df: DataFrame, key, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """D3 (default): fold = floor(k · hash-uniform) (tagged draw, independent
    of a hash split with the same seed)."""
    return df.withColumn(out, F.floor(_u(seed, _keys(key), "fold") * k).cast("int"))


def kfold_exact(df: DataFrame, key, label: str, k: int = 5, seed: int = 42,
                out: str = "fold") -> DataFrame:
    """D3 (exact, stratified): fold = class rank mod k, so every fold holds
    each class within one row of its share."""
    keys = _keys(key)
    r = class_rank(df, key, label, seed, tag="fold")
    fold = r.select(*keys, F.col("__label").alias(label), (F.col("class_rank") % k).cast("int").alias(out))
    same = F.lit(True)
    for c in [*keys, label]:
        same = same & df[c].eqNullSafe(fold[c])
    return df.join(fold, same).select(*[df[c] for c in df.columns], fold[out])


def in_split(split: str, col: str = "split") -> Column:
    return F.col(col) == F.lit(split)
