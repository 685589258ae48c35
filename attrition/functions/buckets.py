"""Bucket index of a value against sorted edges (JVM-side binary search)."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketize(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    """``out`` = number of edges ≤ value (buckets [e_i, e_{i+1})), as a
    double; 0 everywhere when there are no edges."""
    edges = sorted(set(edges))
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf] + edges + [math.inf]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)
