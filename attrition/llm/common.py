"""Helpers shared by the operators: column handling, word splitting, shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import attrition

from attrition.session import ensure_checkpoint_dir

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name
    (upper and lower case count as the same)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def words(text: Column) -> Column:
    """Array of the words of a text (JVM side)."""
    return F.array_remove(F.split(text, SPACE), "")


def byte_words(text: bytes) -> list[bytes]:
    """The same words of a UTF-8 text, A-Z lower-cased: ``bytes.lower`` changes
    only ASCII letters and ``bytes.split`` parts at exactly these six bytes."""
    return text.lower().split()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package where they would not find it: not
    installed and not on the search path that executors inherit.  Spark's own
    file server hands it out, once per application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(attrition.__file__)))
    on_path = root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    sc = spark.sparkContext
    if on_path or "site-packages" in root or any("attrition_package" in f for f in sc.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="attrition-ship-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "attrition_package"), "zip", root, "attrition"))


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder (``spark.checkpoint.dir``)
    and read it back: cuts lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unused folder path (URI or plain path) under the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
