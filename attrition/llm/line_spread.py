"""Line deduplication by the number of distinct sites a line is found on.

Every line is hashed; a HyperLogLog sketch of its sites is built for each hash
and merged by the aggregation itself (partial sketches before the shuffle, so a
line that a third of all documents share costs one sketch per task).  Lines
whose estimate lies well above the threshold are boilerplate, well below are
not; those in between, within the sketch's error, get an exact distinct count.
Boilerplate lines are then removed from every document but the first (smallest
``doc_id``), which keeps its first occurrence.

Defined results: a null text stays null and has no lines; blank lines are never
boilerplate; a null site counts as no site; documents with a null id never
count as first while another has one; rows that share an id share the decision;
an empty table gives an empty result; a document may end with an empty text.
``n_chars`` is not touched here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import WORD, free_name, stored

#: A line found on this many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's registers: relative standard error 1.04 / sqrt(2^12) = 1.6 %.
LG_K = 12
#: Estimates within so many standard errors of the threshold are counted exactly.
SIGMAS = 4.0


def line_hashes(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, text_hash, pos, site, h1, h2) for each line with a word; two
    independent hashes make 96 bits.  ``text_hash`` tells apart rows that share
    an id but not a text."""
    line = F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(site).cast("string").alias("site"), line).where(
        F.col("line").rlike(WORD)).select("key", "text_hash", "pos", "site", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate_lines(hashes: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, sigmas: float = SIGMAS) -> DataFrame:
    """(h1, h2, first_key) of the lines on at least ``min_sites`` distinct sites."""
    error = sigmas * 1.04 / 2 ** (lg_k / 2)
    sketched = stored(hashes.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", lg_k).alias("sketch"), F.min("key").alias("first_key"))
        .select("h1", "h2", "first_key", F.hll_sketch_estimate("sketch").alias("sites"))
        # an estimate below the band can't reach the threshold: it plays no further part
        .where(F.col("sites") >= min_sites * (1 - error) - 1), "line-spread")
    near = F.col("sites") <= min_sites * (1 + error) + 1
    close = sketched.where(near).select("h1", "h2", "first_key")
    exact = (hashes.join(close, ["h1", "h2"]).groupBy("h1", "h2", "first_key", "site").agg(F.lit(1).alias("one"))
             .groupBy("h1", "h2", "first_key").agg(F.count("site").alias("sites"))
             .where(F.col("sites") >= min_sites).select("h1", "h2", "first_key"))
    return sketched.where(~near).select("h1", "h2", "first_key").unionByName(exact)


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source",
                     key: str = "doc_id", lg_k: int = LG_K, removed: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; the same rows and
    columns, and if ``removed`` is given, a column of that name with the number
    of lines taken out.

    Only (key, position, hash) rows are shuffled to find each document's
    boilerplate; the per-document list holds at most its own line numbers."""
    hashes = line_hashes(docs, text, site, key)
    bad = stored(boilerplate_lines(hashes, min_sites, lg_k), "line-boilerplate")
    gone, k, th, cut = (free_name(docs, f"__{x}") for x in ("gone", "key", "text_hash", "cut"))
    per_line = hashes.drop("site").join(bad, ["h1", "h2"]).groupBy("key", "text_hash", "h1", "h2", "first_key").agg(
        F.collect_set("pos").alias("at"))
    dropped = F.when(F.col("key").eqNullSafe(F.col("first_key")), F.array_remove("at", F.array_min("at"))).otherwise(F.col("at"))
    per_doc = per_line.groupBy(F.col("key").alias(k), F.col("text_hash").alias(th)).agg(
        F.flatten(F.collect_list(dropped)).alias(gone))
    joined = docs.join(per_doc, F.col(f"`{key}`").eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(th)), "left")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    tagged = joined.select(*keep, gone, F.when(F.size(gone) > 0, F.split(F.col(text), "\n", -1)).alias(cut))
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(cut), i)), "\n")
    out = [F.when(F.col(cut).isNotNull(), kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`")
           for c in docs.columns]
    if removed:
        out.append(F.when(F.col(cut).isNotNull(), F.size(gone)).otherwise(0).cast("long").alias(removed))
    return tagged.select(*out)
