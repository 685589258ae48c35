"""Boosting: small fits by task and large ones by passes agree; held-out quality; folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import boost, metrics, tune


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(900):
        a, b, c = rng.random(), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
        y = int(rng.random() < (0.9 if a > 0.6 and b != 1.0 else 0.15))
        data.append((f"k{i}", a, b, c if i % 11 else None, y, 1.0 + y, i % 3))
    return spark.createDataFrame(data, "key string, a double, b double, c double, label int, weight double, fit int").cache()


PARAMS = boost.Boosting(rounds=6, learning_rate=0.3, num_leaves=6, min_child_samples=5, reg_alpha=0.5, reg_lambda=1.0, subsample=0.7, colsample=0.7)


def flat(model):
    return [(s.node, s.feature, s.bin, s.n_left, s.n_right, round(s.gain, 6)) for t in model.trees for s in t.splits]


def test_tasks_and_passes_grow_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(boost, "TASK_ROWS", 200)   # several blocks
    monkeypatch.setattr(boost, "CHECKPOINT", 2)
    args = (rows, "key", ["a", "b", "c"], "label", PARAMS, "weight", "fit", 3)
    by_task, by_passes = boost.fit_many(*args), boost.fit_many(*args, task_fit_rows=0)
    for x, y in zip(by_task, by_passes, strict=True):
        assert flat(x) == flat(y) and abs(x.start - y.start) < 1e-9
        assert all(abs(t.values[n] - u.values[n]) < 1e-9 for t, u in zip(x.trees, y.trees, strict=True) for n in t.values)
    assert len({len(m.trees) for m in by_task}) == 1


def test_quality_and_leaf_bounds(rows):
    train, held = rows.where("fit < 2"), rows.where("fit = 2")
    for p in (PARAMS, boost.Boosting.level_wise(3, rounds=10, reg_lambda=1.0)):
        model = boost.fit_many(train, "key", ["a", "b", "c"], "label", p)
        assert all(len(t.splits) < p.num_leaves and min(s.n_left, s.n_right) >= p.min_child_samples for t in model[0].trees for s in t.splits)
        pred = boost.score_many(model, held, "key", "label")
        assert metrics.rank_metrics(pred, "p", "label").first()["auc"] > 0.75  # knowing the rule gives 0.82


def test_rows_that_cannot_be_split(spark, rows):
    one = rows.withColumn("a", F.lit(1.0)).withColumn("label", F.lit(1))
    model = boost.fit_many(one, "key", ["a"], "label", boost.Boosting(rounds=2))[0]
    assert [t.splits for t in model.trees] == [(), ()]
    empty = boost.fit_many(rows.where("false"), "key", ["a"], "label", boost.Boosting(rounds=2))
    assert boost.score_many(empty, rows, "key").select("p").distinct().count() == 1


def test_compare_resamples_inside_the_folds(rows):
    """A resampler that marks its rows sees the training rows of one fit only."""
    seen = []

    def resampled(part):
        seen.append({r.key for r in part.select("key").collect()})
        return part

    held_out = {f: {r.key for r in rows.where(F.col("fit") == f).collect()} for f in range(3)}
    train = rows.withColumnRenamed("fit", "fold")
    test = rows.where("fit = 0").drop("fit")
    table = tune.compare({"boosted": tune.boosted({"n_estimators": 5}, PARAMS, ["a", "b", "c"], "key", "label", "weight")},
                         train, test, "label", folds=3, resample=resampled).collect()
    assert sorted(map(len, seen)) == [600, 600, 600, 900]
    assert sum(not (s & held_out[f]) for s in seen for f in range(3)) == 3
    assert 0.7 < table[0]["cv_mean"] <= 1 and table[0]["tp"] + table[0]["fn"] + table[0]["tn"] + table[0]["fp"] == 300


def test_halving_keeps_the_best_trials(rows):
    def objective(pred):
        return metrics.rank_metrics(pred, "p", "label").first()["auc"], 0.5

    from attrition.operators import models
    space = {"n_estimators": tune.Draw("int", 9, 18), "max_depth": tune.Draw("int", 1, 4)}
    train, valid = rows.where("fit < 2").fillna(0.0), rows.where("fit = 2").fillna(0.0)
    table, best, model = tune.halving_search(lambda p: models.pipeline(["a", "b", "c"], models.forest(p["n_estimators"], p["max_depth"])), space, 6,
                                             train, valid, "key", "label", objective)
    got = table.collect()
    assert [sum(r.rung == k for r in got) for k in range(3)] == [6, 2, 1]
    assert best["value"] == max(r.value for r in got if r.rung == 2) and best["params"]["n_estimators"] == model.stages[-1].getNumTrees


def test_a_task_keeps_nodes_and_gradients_between_passes_with_the_same_sums():
    r = np.random.default_rng(5)
    n = 500
    x = r.integers(0, 9, (n, 3)).astype(np.uint8)
    block = (x, r.integers(0, 2, n).astype(float), r.choice([0.35, 0.65], n), np.zeros(n, np.int16), r.integers(-2**62, 2**62, n), r.normal(size=n))
    p = boost.Boosting(rounds=4, num_leaves=6, min_child_samples=5, subsample=0.8)
    edges = [tuple(map(float, range(8)))] * 3
    kept, fresh = boost.TaskSums(block), [block]

    def both(*request):
        got, want = kept(*request), boost.block_sums(fresh[0], *request)
        assert np.array_equal(got, want)
        return got

    def step(number, trees):
        fresh[0] = kept.block = boost.step_margins(kept.block, trees)

    trees = boost.grow_rounds(p, edges, [0], both, step)[0]
    assert len(trees) == 4 and all(len(t.splits) > 1 for t in trees)


def test_rows_of_the_same_bins_are_summed_with_the_same_trees(rows):
    twice = rows.withColumn("a", F.round("a", 1)).withColumn("c", F.round("c", 0)).withColumn("fit", F.col("fit") % 2)
    for p in (PARAMS, boost.Boosting.level_wise(3, rounds=5, reg_lambda=1.0)):
        args = (twice, "key", ["a", "b", "c"], "label", p, "weight", "fit", 2)
        for x, y in zip(boost.fit_many(*args), boost.fit_many(*args, cell_rows=0), strict=True):
            assert flat(x) == flat(y) and any(len(t.splits) > 2 for t in x.trees)
            assert all(abs(t.values[n] - u.values[n]) < 1e-9 for t, u in zip(x.trees, y.trees, strict=True) for n in t.values)


def test_a_level_wise_round_takes_a_pass_a_level():
    r = np.random.default_rng(6)
    block = (r.integers(0, 30, (3000, 4)).astype(np.uint8), r.integers(0, 2, 3000).astype(float), np.ones(3000), np.zeros(3000, np.int16),
             np.arange(3000), np.zeros(3000))
    total, asked = boost.CellSums(block), []
    p = boost.Boosting.level_wise(6, rounds=1, reg_lambda=1.0)
    trees = boost.grow_rounds(p, [tuple(map(float, range(29)))] * 4, [0], lambda *a: asked.append(a) or total(*a), None)[0]
    assert len(trees[0].splits) > 40 and len(asked) == 6 + 1
