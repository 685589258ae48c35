"""Deterministic pseudo-randomness from keys.

Every random choice in the library (splits, folds, samples, SMOTE partners
and gaps, search-space draws) is a pure function of ``(seed, key, tag)``:
``u = int(first 8 hex digits of md5(seed|key|tag)) / 2**32``.  It needs no
shuffle, gives the same answer after an executor is lost and recomputed, and
is reproducible bit for bit in DuckDB (``duckdb_uniform``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_text(seed: int, *parts) -> Column:
    """``'seed|p1|p2…'``; parts are column names, Columns or literals."""
    cols = [F.lit(str(seed))]
    for p in parts:
        if isinstance(p, Column):
            cols.append(p.cast("string"))
        elif isinstance(p, str):
            cols.append(F.col(p).cast("string"))
        else:
            cols.append(F.lit(str(p)))
    return F.concat_ws("|", *cols)


def hash_uniform(seed: int, *parts) -> Column:
    """Uniform double in [0, 1) from md5 of the parts."""
    h = F.md5(hash_text(seed, *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def duckdb_uniform(seed: int, *parts: str) -> str:
    """DuckDB SQL text computing the same number as :func:`hash_uniform`.

    ``parts`` are SQL expressions (column names or quoted literals)."""
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {args})), 1, 8)) AS UBIGINT)"
            f" / 4294967296.0::DOUBLE)")


def spark_sql_uniform(seed: int, *parts: str) -> str:
    """Spark SQL text of :func:`hash_uniform` (for ``selectExpr``)."""
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS STRING)" for p in parts])
    return (f"(CAST(conv(substr(md5(concat_ws('|', {args})), 1, 8), 16, 10) AS BIGINT)"
            f" / 4294967296.0D)")
