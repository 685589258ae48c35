"""Neighbour searches whose vectors a task holds whole: the same neighbours as by cells, ties included."""

import numpy as np
import pytest

from attrition.operators import neighbors


@pytest.mark.parametrize("metric,nominal", [("euclidean", ["c"]), ("manhattan", [])])
def test_the_same_neighbours_as_by_cells(spark, monkeypatch, metric, nominal):
    r = np.random.default_rng(8)
    data = [(f"k{i}", *map(float, r.integers(0, 12, 2)), int(r.integers(0, 3))) for i in range(400)]
    df = spark.createDataFrame(data, "id string, a double, b double, c int")

    def found():
        out = neighbors.knn(df, df, "id", "id", ["a", "b"], 4, metric, nominal, 2.5, self_join=True, per_cell=16)
        return sorted((x["id"], x["rank"], x["nkey"], round(x["dist"], 9)) for x in out.collect())

    by_cells = found()
    met = []
    whole = neighbors._meet_whole
    monkeypatch.setattr(neighbors, "WHOLE_FROM", 1)
    monkeypatch.setattr(neighbors, "TASK_ROWS", 50)
    monkeypatch.setattr(neighbors, "_meet_whole", lambda *a: met.append(a[-1]) or whole(*a))
    assert found() == by_cells and len(by_cells) == 1600 and met[0] > 1
