"""Nominal boosting over cells: the rounds of MLlib's, on tables where both cut the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import models, nominal


def rows(spark, n, seed=3):
    r = np.random.default_rng(seed)
    a, b, s = r.integers(0, 9, n), r.integers(0, 6, n), r.integers(0, 5, n)
    y = (a * 0.3 + np.array([2, -1, 0, 3, -2])[s] + b * (s % 2) * 0.5 + r.normal(scale=1.5, size=n) > 1.5).astype(int)
    return spark.createDataFrame([(i, float(a[i]), float(b[i]), "vwxyz"[s[i]], int(y[i]), 0.32 + 0.36 * int(y[i])) for i in range(n)],
                                 "id long, a double, b double, s string, label int, weight double")


def fitted(df):
    return models.nominal_boosting_pipeline(["a", "b"], ["s"], 12, 0.1, 4, "weight").fit(df)


def test_beyond_the_limit_the_rounds_are_mllibs(spark, monkeypatch):
    train, held = rows(spark, 2500), rows(spark, 500, seed=4).withColumn("s", F.when(F.col("id") == 1, "new").otherwise(F.col("s")))
    theirs = fitted(train)
    monkeypatch.setattr(models, "MLLIB_BOOSTING_ROWS", 100)
    ours = fitted(train)
    assert isinstance(ours.stages[-1], models.BoostedModel) and not isinstance(theirs.stages[-1], models.BoostedModel)
    a, b = ({r["id"]: (r["p"], r["pred"]) for r in models.score(m, held, "id").collect()} for m in (ours, theirs))
    assert len(a) == 500 and all(a[i][0] == pytest.approx(b[i][0], abs=1e-6) and a[i][1] == b[i][1] for i in a)
    monkeypatch.setattr(nominal, "MOST_CELLS", 10)
    assert not isinstance(fitted(train).stages[-1], models.BoostedModel)


@pytest.mark.parametrize("column", ["label", "a"])
def test_null_labels_and_features_stay_errors(spark, monkeypatch, column):
    monkeypatch.setattr(models, "MLLIB_BOOSTING_ROWS", 10)
    bad = rows(spark, 60).withColumn(column, F.when(F.col("id") > 7, F.col(column)))
    with pytest.raises(Exception):
        fitted(bad)
