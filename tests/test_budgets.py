"""The registered workflows run at the workload's own budgets."""

import pytest

from attrition.operators import models, tune
from attrition.plans import pipelines, q_models


@pytest.mark.parametrize(("name", "budget"), [("comparison", pipelines.ComparisonBudget), ("ensemble", pipelines.EnsembleBudget),
                                              ("segmentation", pipelines.SegmentationBudget)])
def test_registered_workflow_has_the_default_budget(monkeypatch, name, budget):
    seen = []
    monkeypatch.setattr(pipelines, name, lambda spark, sf_dir, seed=42, budget=None: seen.append(budget))
    getattr(pipelines, f"{name}_pipeline")(None, "")
    assert seen[0] in (None, budget())


def test_default_budgets():
    c, e, s = pipelines.ComparisonBudget(), pipelines.EnsembleBudget(), pipelines.SegmentationBudget()
    assert (c.folds, c.forest, c.svm["n_components"]) == (5, {"n_estimators": 100, "max_depth": 20}, 100)
    assert [x["n_estimators"] for x in (c.boosting, c.xgb_style, c.leafwise_style, c.weighted_style)] == [100, 100, 730, 111]
    assert (e.trials, e.n_estimators, e.max_depth, e.boosting["n_estimators"], e.boosting["depth"]) == (30, (100, 500), (3, 30), 111, 8)
    assert (s.k_max, s.forest["n_estimators"], s.forest["max_depth"]) == (10, 213, 29)


def _built(monkeypatch, name):
    """The estimator that a fit query makes, without fitting it."""
    made = []
    monkeypatch.setattr(q_models, "_fit_eval", lambda spark, sf_dir, model, make, weighted=None: made.append(make))
    getattr(q_models, name)(None, "")
    return made[0]


@pytest.mark.parametrize(("name", "rounds", "depth"), [("fit_gbt", 100, 3), ("fit_gbt_weighted", 100, 6)])
def test_boosting_queries_have_the_workloads_rounds(spark, monkeypatch, name, rounds, depth):
    est = _built(monkeypatch, name)(1, None).getStages()[-1]
    assert (est.getMaxIter(), est.getMaxDepth()) == (rounds, depth)


def test_leafwise_model_has_the_workloads_settings():
    p = models.leafwise(**pipelines.ComparisonBudget().leafwise_style)
    assert (p.rounds, p.num_leaves, p.max_depth, p.min_child_samples) == (730, 9, 13, 106)
    assert round(p.reg_alpha, 3) == 5.834 and round(p.reg_lambda, 3) == 1.478


def test_forest_query_has_the_workloads_trees(spark, monkeypatch):
    est = _built(monkeypatch, "fit_forest")(1, None).getStages()[-1]
    assert (est.getNumTrees(), est.getMaxDepth()) == (100, 20)


def test_nominal_boosting_query_has_the_workloads_rounds(spark, monkeypatch):
    rows = spark.createDataFrame([("en", "a")], "lang string, source string")
    est = _built(monkeypatch, "fit_gbt_nominal")(1, rows).getStages()[-1]
    assert (est.getMaxIter(), est.getMaxDepth()) == (111, 8)


def test_search_ranges_and_models():
    assert 20 in q_models.FOREST_GRID["maxDepth"] and 100 in q_models.FOREST_GRID["numTrees"]
    assert (q_models.FOREST_SPACE["n_estimators"].lo, q_models.FOREST_SPACE["n_estimators"].hi) == (100, 500)
    assert q_models.N_PERM >= 400


def test_leaderboard_takes_nine_models_and_candidates(spark):
    rows = spark.createDataFrame([(i, i / 40, (i * 7 % 40) / 40, 0.5, 0.25, 0.75, int(i >= 20), 1.0) for i in range(40)],
                                 ["doc_id", *q_models.DOC_FEATS, "label", "weight"])
    board = q_models._board(rows)
    assert len(board) == 9
    got = tune.leaderboard({k: board[k] for k in ("knn", "tree")}, rows, rows, "doc_id", "label").collect()
    assert {r["model"]: r["accuracy"] for r in got}["knn"] == 1.0
