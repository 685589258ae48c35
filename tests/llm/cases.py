"""Rows that every operator must survive, and helpers."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=300):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def awkward_rows():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    body = " ".join(words(rng, 80))
    long = "\n".join(" ".join(words(rng, 40, 5000)) for _ in range(900))
    rows = [
        (1, body, "en", "a", 1), (2, body, "en", "b", 1), (2, body, "en", "b", 1), (2, body + " tail", None, "b", None),
        (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, " \t\n\x0b\x0c\r ", None, "c", 7), (None, body, None, None, None),
        (None, None, None, None, None), (6, long, "en", "a", len(long)), (7, "one", "en", "a", 3), (8, "One  two", "en", "a", 8),
        (9, "Ünï   cödé 　 words\x1c x", "de", "a", 20), (-1, "negative id", "en", "a", 11),
    ]
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, *names):
    """The awkward rows with extra columns of the operators' own names."""
    return awkward(spark).select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)
