"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; projections and filters applied
    later are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             key: str | None = None, header: bool = True) -> DataFrame:
    """CSV scan with a header row.

    Pass ``schema`` in production (no inference pass over the data).  Without
    it, types are inferred from all rows in one more pass.  When the file's first
    column is a bare row number (pandas ``index_col=0``), ``key`` renames it
    so it is carried as an explicit key rather than an implicit index.
    """
    reader = spark.read.option("header", header).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    if key is not None and key not in df.columns:
        df = df.withColumnRenamed(df.columns[0], key)
    return df


def paired_scan(train: DataFrame, score: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """A labelled training table and an unlabelled scoring table with
    the same features.  Checks that ``score``'s schema is ``train`` minus the
    label (names and types) and returns both with the score set's columns in
    the training order."""
    want = [f for f in train.schema.fields if f.name != label]
    have = {f.name: f.dataType for f in score.schema.fields if f.name != label}
    missing = [f.name for f in want if f.name not in have]
    wrong = [f.name for f in want if f.name in have and have[f.name] != f.dataType]
    if missing or wrong:
        raise ValueError(f"score set differs from training set: missing={missing} type={wrong}")
    return train, score.select(*[f.name for f in want])


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a metrics / predictions table as Parquet."""
    df.write.mode(mode).parquet(path)


def save_model(model, path: str) -> None:
    """Persist a fitted MLlib model or pipeline."""
    model.write().overwrite().save(path)
