"""Scoring a stream with state fitted in batch (P6, E5, M11 on streams).

The reference has no streaming operator.  What carries over is that every
fitted transform is stateless per row: a scaler with fitted constants, a
``PipelineModel`` and a threshold apply unchanged to a streaming DataFrame,
so new records can be scored as they arrive (``readStream`` → ``transform``
→ ``writeStream``).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(stream: DataFrame, model, key: str, threshold: float = 0.5,
                 prep=None) -> DataFrame:
    """Apply optional fitted preprocessing (``Prep``/``Scaler``), a fitted
    pipeline and a decision threshold to a (streaming) DataFrame."""
    df = prep.transform(stream) if prep is not None else stream
    out = model.transform(df)
    p = vector_to_array("probability")[1]
    return out.select(key, p.alias("p"), (p >= F.lit(threshold)).cast("int").alias("pred"))


def run_to_table(scored: DataFrame, table: str, checkpoint: str):
    """Start the streaming query into an in-process table (append mode).
    The checkpoint location must be in the shared checkpoint folder."""
    return (scored.writeStream.format("memory").queryName(table).outputMode("append")
            .option("checkpointLocation", checkpoint).start())
