"""Projection, filtering and cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.operators.ordinal import dense_index
from attrition.operators.profile import numeric_columns


def table_profile(df: DataFrame) -> DataFrame:
    """S3: per column its position, type, non-null count, and the table's
    row and column counts; one aggregation job."""
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.count(F.col(f.name)).alias(f"__nn{i}") for i, f in enumerate(fields)])
    per_col = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                        F.lit(f.dataType.simpleString()).alias("type"),
                        F.col(f"__nn{i}").alias("non_null"))
               for i, f in enumerate(fields)]
    return counts.select(F.col("__rows").alias("n_rows"), F.lit(len(fields)).alias("n_cols"),
                         F.explode(F.array(*per_col)).alias("c")).select("c.*", "n_rows", "n_cols")


def preview(df: DataFrame, cols: list[str], key: str | list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key (top-k, not a full sort)."""
    keys = [key] if isinstance(key, str) else key
    return df.select(*dict.fromkeys(keys + cols)).orderBy(*keys).limit(n)


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """P1."""
    return df.drop(*cols)


def select_numeric(df: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Keep numeric columns only."""
    return df.select(*numeric_columns(df, exclude))


def bool_to_int(df: DataFrame) -> DataFrame:
    """Every boolean column cast to int."""
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType)
                       else F.col(f.name) for f in df.schema.fields])


def class_filter(df: DataFrame, label: str, value: int = 1) -> DataFrame:
    """P5: rows of one class (pushed into the scan when ``label`` is stored)."""
    return df.where(F.col(label) == value)


def renumber(df: DataFrame, key: str | list[str], out: str = "row_no") -> DataFrame:
    """Dense 0-based row number in key order (distributed, exact)."""
    keys = [key] if isinstance(key, str) else key
    return dense_index(df, keys, out)


def null_counts(df: DataFrame) -> DataFrame:
    """``column, n_null`` in one pass."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("n_null"))
        for i, c in enumerate(cols)])).alias("c")).select("c.*")


def dropna_any(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """C2."""
    return df.na.drop("any", subset=subset)


def _null_safe_join(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in cols])


def _key(key: str | list[str]) -> Column:
    return F.col(key) if isinstance(key, str) else F.struct(*[F.col(k) for k in key])


def first_key_per_group(df: DataFrame, cols: list[str], key: str | list[str]) -> DataFrame:
    """Smallest key per group of identical ``cols`` (hash aggregate with
    map-side combine, so a hot group costs one row per partition)."""
    return (df.groupBy(*cols).agg(F.min(_key(key)).alias("__first"))
            .select(*[F.col(c).alias(f"__g_{c}") for c in cols], "__first"))


def duplicate_flags(df: DataFrame, cols: list[str], key: str | list[str],
                    out: str = "is_dup") -> DataFrame:
    """0 for the first occurrence (smallest key) of each identical row
    over ``cols``, 1 for later copies.  Join back on the group columns; a
    hot group is split by AQE's skew-join handling since the other side has
    one row per group."""
    first = first_key_per_group(df, cols, key)
    j = df.join(first, _null_safe_join(cols), "inner")
    return j.select(*df.columns,
                    (_key(key) != F.col("__first")).cast("int").alias(out))


def duplicate_rows(df: DataFrame, cols: list[str], key: str | list[str]) -> DataFrame:
    """Second and later copies."""
    return duplicate_flags(df, cols, key).where(F.col("is_dup") == 1).drop("is_dup")


def dedup_keep_first(df: DataFrame, cols: list[str], key: str | list[str]) -> DataFrame:
    """C4: one row per identical ``cols``, the one with the smallest key;
    other columns come from that row (``min_by`` aggregate, combinable)."""
    others = [c for c in df.columns if c not in cols]
    if not others:
        return df.dropDuplicates(cols)
    return (df.groupBy(*cols)
            .agg(F.min_by(F.struct(*others), _key(key)).alias("__keep"))
            .select(*cols, "__keep.*")
            .select(*df.columns))


def null_map(df: DataFrame, key: str, buckets: int = 20, cols: list[str] | None = None) -> DataFrame:
    """Null rate per (key bucket, column): the data of a missing-value
    heat map with bounded size."""
    cols = cols or [c for c in df.columns if c != key]
    lo = df.select(F.min(key)).scalar()
    hi = df.select(F.max(key)).scalar()
    bucket = F.floor((F.col(key) - lo) * buckets / (hi - lo + 1)).cast("int")
    flags = df.select(bucket.alias("bucket"),
                      *[F.col(c).isNull().cast("int").alias(c) for c in cols])
    return (flags.unpivot(["bucket"], cols, "column", "is_null")
            .groupBy("bucket", "column").agg(F.avg("is_null").alias("null_rate"),
                                             F.count(F.lit(1)).alias("n")))


def zip_columns(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Column-wise concatenation of two tables that share a key."""
    return a.join(b, key, "inner")
