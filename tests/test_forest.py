"""The forest whose trees are grown in tasks: against MLlib's, across cuts into cells, and
read at fewer trees and levels."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from attrition.operators import forest, metrics, models


def rows(spark, n, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(scale=0.7, size=n) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, label int")


def arrays(df):
    return df.withColumn("x", F.array("a", "b", "c", "d"))


def table(df):
    return {(r["variant"], r["id"]): r["p"] for r in df.collect()}


def test_beyond_the_limit_no_tree_is_mllibs_and_scores_are_as_good(spark, monkeypatch):
    monkeypatch.setattr(models, "MLLIB_FOREST_ROWS", 100)
    train, held = rows(spark, 3000), rows(spark, 1500, seed=4)
    made = models.pipeline(list("abcd"), models.forest(20, 8, 5)).fit(train)
    assert isinstance(made.stages[-1], models.GrownForest)
    theirs = models.pipeline(list("abcd"), RandomForestClassifier(numTrees=20, maxDepth=8, minInstancesPerNode=5, seed=42)).fit(train)
    auc = [metrics.rank_metrics(models.score(m, held, "id", "label"), "p", "label").first()["auc"] for m in (made, theirs)]
    assert abs(auc[0] - auc[1]) < 0.02 and auc[0] > 0.8
    got = {r["feature"]: r["importance"] for r in models.importances(made, list("abcd")).collect()}
    want = {r["feature"]: r["importance"] for r in models.importances(theirs, list("abcd")).collect()}
    assert sum(got.values()) == pytest.approx(1.0) and all(abs(got[f] - want[f]) < 0.08 for f in got)


def test_cells_and_partitions_do_not_change_the_forest(spark):
    df = arrays(rows(spark, 1200).unionByName(rows(spark, 1200).where("id < 100")))
    held = arrays(rows(spark, 400, seed=5))
    p = forest.Forest(6, 7, 3, 2)
    one = forest.fit(df, "x", 4, "label", None, p, 1300, (3,))
    cut = forest.fit(df.repartition(7), "x", 4, "label", None, p, 1300, (3,), cell_rows=200)
    assert any(len(t["feature"]) > 1 for t in cut.tops) and all(len(t["feature"]) == 1 for t in one.tops)
    variants = [(6, 7), (4, 3)]
    a, b = (table(forest.score(g, held, "id", "x", variants)) for g in (one, cut))
    assert a == b and len(a) == 800
    assert np.allclose(one.importances, cut.importances)


def test_fewer_trees_and_levels_are_read_from_a_larger_forest(spark):
    df, held = arrays(rows(spark, 800)), arrays(rows(spark, 300, seed=6))
    large = forest.fit(df, "x", 4, "label", None, forest.Forest(8, 9, 2, 2), 800, (4,))
    small = forest.fit(df, "x", 4, "label", None, forest.Forest(5, 4, 2, 2), 800)
    got = table(forest.score(large, held, "id", "x", [(5, 4)]))
    assert got == table(forest.score(small, held, "id", "x"))


def test_a_split_is_the_best_of_all_cuts():
    r = np.random.default_rng(1)
    x, y, w = r.integers(0, 6, 60), r.integers(0, 2, 60), r.choice([0.35, 0.65], 60)
    w0, w1 = np.where(y == 0, w, 0.0), np.where(y == 1, w, 0.0)

    def gini(at):
        a, b = w0[at].sum(), w1[at].sum()
        return 2 * a * b / (a + b)

    gains = {b: (gini(x >= 0) - gini(x <= b) - gini(x > b)) / w.sum() for b in range(5) if min((x <= b).sum(), (x > b).sum()) >= 7}
    gain, cut = forest.best_splits(x, np.ones(60), w0, w1, 1, 6, 7)
    assert gain[0] == pytest.approx(max(gains.values())) and cut[0] == max(gains, key=gains.get)


@pytest.mark.parametrize("column", ["CASE WHEN id > 7 THEN label END AS label, 1.0 AS w", "label, CASE WHEN id > 7 THEN 1.0 END AS w"])
def test_null_labels_and_weights_stay_errors(spark, monkeypatch, column):
    monkeypatch.setattr(models, "MLLIB_FOREST_ROWS", 10)
    bad = rows(spark, 60).selectExpr("id", *"abcd", *column.split(", "))
    with pytest.raises(Exception, match="MUST NOT"):
        models.pipeline(list("abcd"), models.forest(2, 3, weight_col="w")).fit(bad)


def test_rows_of_the_same_bins_are_summed_with_the_same_trees():
    r = np.random.default_rng(2)
    x, y, h = r.integers(0, 5, (4000, 3)).astype(np.uint8), r.integers(0, 2, 4000).astype(float), r.integers(-2**62, 2**62, 4000)
    w, p = np.where(y > 0, 0.75, 0.25), forest.Forest(1, 9, 3, 2)
    cells = forest.Rows(x, y, w, h)
    assert cells.fewer and len(cells.x) <= 125
    c = forest.times_drawn(h, p, 0)
    assert np.array_equal(c, np.searchsorted(forest.POISSON, forest._uniform(h, p.seed * 15_485_863), side="right"))
    at = np.flatnonzero(c)
    want = forest.grow_drawn(x[at], c[at].astype(float), np.where(y > 0, 0, w * c)[at], np.where(y > 0, w * c, 0)[at], p, 5, 0)
    got = forest.grow_drawn(*cells.drawn(p, 0), p, 5, 0)
    assert len(got["feature"]) > 9 and all(np.array_equal(got[k], want[k]) for k in ("feature", "cut", "left", "w0", "w1"))


def test_trials_read_their_forests_from_shared_trees(spark, monkeypatch):
    monkeypatch.setattr(models, "MLLIB_FOREST_ROWS", 100)
    train, held = rows(spark, 900), rows(spark, 300, seed=7)
    sizes = [(4, 6, 2), (7, 3, 2), (5, 8, 9)]
    made = [models.pipeline(list("abcd"), models.forest(*s)) for s in sizes]
    grown = []
    fit_many = forest.fit_many
    monkeypatch.setattr(forest, "fit_many", lambda *a: grown.append(a[5]) or fit_many(*a))
    together = models.fit_all(made, train)
    assert [[(p.trees, p.max_depth, p.min_rows) for p in ps] for ps in grown] == [[(7, 6, 2), (5, 8, 9)]]
    for one, est in zip(together, made, strict=True):
        alone = est.fit(train)
        assert np.allclose(one.stages[-1].featureImportances.toArray(), alone.stages[-1].featureImportances.toArray())
        a, b = ({r["id"]: r["p"] for r in models.score(m, held, "id").collect()} for m in (one, alone))
        assert a == b and len(a) == 300
    for one, pred in zip(together, models.score_all(together, held, "id", "label"), strict=True):
        assert sorted(pred.collect()) == sorted(models.score(one, held, "id", "label").collect())
