"""The corpus pipeline: documents → quality rules → line dedup → near-dedup →
decontamination → packed sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read again as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm import bin_packing, decontam, line_spread, quality_rules, simhash_dups
from attrition.llm.common import stored
from attrition.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality_rules.filter_by_policy(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without cross-site boilerplate lines; ``n_chars`` follows
    a text that has changed."""
    removed = "__removed"
    cleaned = line_spread.drop_boilerplate(docs, removed=removed)
    out = [F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
           if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cleaned.select(*out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash_dups.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the remaining documents."""
    return bin_packing.packed_table(docs).withColumnRenamed("key", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: Fingerprints and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
