"""Neighbour grid, Newton steps, k-means for all k, bootstrap and target statistics on
awkward small tables, against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from attrition.operators import encode, knn_grid, models, neighbors, newton, profile, segment, tune


def draws(text):
    h = hashlib.md5(text.encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) / 2 ** 32 for i in range(4)]


@pytest.fixture(scope="module")
def points(spark):
    r = random.Random(5)
    rows = [(i, i % 3, float(r.randrange(4)), float(r.randrange(4)), int(r.random() < 0.4)) for i in range(60)]
    rows += [(100 + i, i % 3, 1.0, 1.0, i % 2) for i in range(30)]  # a third shares one vector
    return rows, spark.createDataFrame(rows, "id int, fold int, x double, z double, y int")


def brute_votes(query, refs, k, metric, weights):
    near = []
    for r in refs:
        dx, dz = query[2] - r[2], query[3] - r[3]
        near.append((dx * dx + dz * dz if metric == "euclidean" else abs(dx) + abs(dz), r[0], r[4]))
    near = sorted(near)[:k]
    dist = [math.sqrt(d) if metric == "euclidean" else d for d, _, _ in near]
    w = [1.0] * k if weights == "uniform" else [float(d == 0) for d in dist] if dist[0] == 0 else [1 / d for d in dist]
    return int(sum(a for a, (_, _, y) in zip(w, near, strict=True) if y) / sum(w) > 0.5 + 1e-9)


def test_neighbour_grid(points):
    rows, df = points
    got = {(r["metric"], r["weights"], r["k"]): r for r in knn_grid.cv_grid(df, "id", "y", ["x", "z"], "fold", 3, 6).collect()}
    assert len(got) == 2 * 2 * 6
    for (metric, weights, k), r in got.items():
        acc = []
        for f in range(3):
            te, tr = [x for x in rows if x[1] == f], [x for x in rows if x[1] != f]
            acc.append(np.mean([brute_votes(q, tr, k, metric, weights) == q[4] for q in te]))
        assert r["n_folds"] == 3
        assert r["accuracy_mean"] == pytest.approx(np.mean(acc)) and r["accuracy_std"] == pytest.approx(np.std(acc))


def test_winner_on_the_holdout(points):
    rows, df = points
    cell = {"metric": "manhattan", "weights": "distance", "k": 4}
    train, test = df.where("fold < 2"), df.where("fold = 2")
    got = {r["id"]: r["pred"] for r in knn_grid.holdout_votes(train, test, "id", "y", ["x", "z"], cell).collect()}
    refs = [r for r in rows if r[1] < 2]
    assert got == {q[0]: brute_votes(q, refs, 4, "manhattan", "distance") for q in rows if q[1] == 2}


def test_newton_finds_the_minimum(spark):
    r = random.Random(1)
    rows = [(r.gauss(0, 1), r.gauss(0, 2), float(r.random() < 0.3), r.choice([1.0, 3.0])) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (1.0, 1.0, None, 1.0)], "a double, b double, y double, w double")
    beta = newton.fit_logistic(df, ["a", "b"], "y", l2=2.0, weight="w").coef
    x = np.array([[1.0, a, b] for a, b, _, _ in rows])
    y, w = (np.array([q[i] for q in rows]) for i in (2, 3))
    p = 1 / (1 + np.exp(-x @ beta))
    assert np.abs((w * (p - y)) @ x + 2.0 * beta * [0, 1, 1]).max() < 1e-6


def test_newton_separable_and_empty(spark):
    df = spark.createDataFrame([(-1.0, 0.0), (1.0, 1.0), (2.0, 1.0)], "a double, y double")
    fit = newton.fit_logistic(df, ["a"], "y")
    assert np.isfinite(fit.coef).all() and fit.coef[1] > 0
    assert df.select(fit.probability().alias("p")).where("p between 0 and 1").count() == 3
    assert newton.fit_logistic(df.limit(0), ["a"], "y").coef.tolist() == [0.0, 0.0]


def test_kmeans_of_all_k(spark, points):
    rows, df = points
    curve, centres = segment.kmeans_all_k(df.select("id", "x", "z").unionByName(spark.createDataFrame([(999, None, 1.0)], "id int, x double, z double")),
                                          "id", ["x", "z"], 4, 7)
    x = np.array([r[2:4] for r in rows])
    first = x[sorted(range(len(rows)), key=lambda i: (draws(f"7|{rows[i][0]}")[0], rows[i][0]))[:4]]
    for k, sse in sorted(tuple(r) for r in curve.collect()):
        c = first[:k].copy()
        for _ in range(300):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c, rtol=1e-12, atol=0):
                break
            c = new
        assert sse == pytest.approx(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
        assert np.allclose(centres[k], c)
    assert segment.kmeans_all_k(df.limit(0), "id", ["x", "z"], 3)[0].collect() == []
    assert [r["k"] for r in segment.kmeans_all_k(df.limit(2), "id", ["x", "z"], 5)[0].collect()].__len__() == 2


def test_bootstrap(spark):
    rows = [(i, ["a", "b", None][i % 3], float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame([*rows, (77, "a", None), (78, "only null", None)], "id int, g string, x double")
    got = {r["g"]: r for r in profile.bootstrap_mean_ci(df, "id", "g", "x", n_boot=50).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        means = []
        for rep in range(50):
            s = n = 0
            for i, own, x in rows:
                if own == g:
                    u = draws(f"42|{i}|{rep // 4}")[rep % 4]
                    t = sum(u >= c for c in profile.POISSON_CDF)
                    s, n = s + t * x, n + t
            if n:
                means.append(s / n)
        assert r["n_boot"] == len(means) and r["n"] == 20
        assert [r["ci_lo"], r["ci_hi"]] == pytest.approx(np.quantile(means, [0.025, 0.975]))
    assert profile.bootstrap_mean_ci(df.limit(0), "id", "g", "x", n_boot=10).collect() == []


@pytest.mark.parametrize("buckets", [1, 5])
def test_ordered_target_statistics(spark, buckets):
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "hot", "cold", None]), r.choice([0, 1, 1, None])) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, c string, y int")
    got = {q["id"]: q["c__ts"] for q in encode.ordered_target_stats(df, "id", "y", ["c"], prior_weight=2.0, buckets=buckets).collect()}
    known = [y for _, _, y in rows if y is not None]
    p, seen = sum(known) / len(known), {}
    for i, c, y in sorted(rows, key=lambda q: draws(f"42|{q[0]}|order")[0]):
        s, n = seen.get(c, (0, 0))
        assert got[i] == pytest.approx((s + 2 * p) / (n + 2))
        if y is not None:
            seen[c] = (s + y, n + 1)
    total = {q["c"]: q["c__ts"] for q in encode.target_stats(df, "y", "c", 2.0).collect()}
    assert total["hot"] == pytest.approx((seen["hot"][0] + 2 * p) / (seen["hot"][1] + 2))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_over_many_cells_with_columns_that_agree_or_differ(spark, metric):
    """Small cells, folds that follow a feature (a query's own cell may hold no row of
    another fold), a few crowded vectors and a null code."""
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.random(), None) for i in range(240)]
    rows = [(i, x, z, int(x * 3)) for i, x, z, _ in rows] + [(1000 + i, 0.5, 0.5, i % 3) for i in range(30)]
    df = spark.createDataFrame([*rows, (2000, 0.5, 0.5, None)], "id long, x double, z double, fold int")
    for option in ("within", "apart"):
        got = {}
        for r in neighbors.knn(df, df, "id", "id", ["x", "z"], 5, metric, per_cell=6, **{option: ["fold"]}).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["nkey"]))

        def d(a, b):
            gaps = [abs(u - v) for u, v in zip(a[1:3], b[1:3], strict=True)]
            return sum(g * g for g in gaps) if metric == "euclidean" else sum(gaps)
        want = {a[0]: [n for _, n in sorted((d(a, b), b[0]) for b in rows if (a[3] == b[3]) == (option == "within"))[:5]] for a in rows}
        assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want


def test_kmeans_scans_only_ks_that_move(spark, monkeypatch):
    """A k whose centres rest takes no part in later scans, and a scan has few tasks."""
    df = spark.createDataFrame([(i, float(i * i % 97), float(i % 13)) for i in range(300)], "id int, x double, z double").repartition(20)
    seen, real = [], segment._centre_sums
    monkeypatch.setattr(segment, "_centre_sums", lambda rows, features, centres: seen.append((sorted(centres), rows.rdd.getNumPartitions())) or real(rows, features, centres))
    segment.kmeans_all_k(df, "id", ["x", "z"], 5)
    assert seen[0][0] == [1, 2, 3, 4, 5] and len(seen[-2][0]) < 5 and 1 not in seen[2][0]
    assert {tasks for _, tasks in seen} == {1}


def test_elbow_tasks_follow_the_rows(spark, monkeypatch):
    df = spark.createDataFrame([(float(i * i % 97), float(i % 13)) for i in range(300)], "x double, z double").repartition(40)
    seen, real = [], segment.fit_kmeans
    monkeypatch.setattr(segment, "fit_kmeans", lambda rows, *a, **o: seen.append(rows.rdd.getNumPartitions()) or real(rows, *a, **o))
    assert segment.elbow_curve(df, ["x", "z"], 3).count() == 3
    assert max(seen) <= segment.LEAST_TASKS


def test_bootstrap_repeats_no_row(spark):
    """No row per replicate; infinite values only count where they are taken; many groups."""
    df = spark.createDataFrame([(i, i % 3, float(i) if i != 4 else float("inf")) for i in range(30)], "id int, g int, x double")
    out = profile.bootstrap_mean_ci(df, "id", "g", "x", n_boot=40)
    assert "Generate" not in out._jdf.queryExecution().toString()
    assert all(r["n_boot"] == 40 and r["n"] == 10 for r in out.collect())
    assert not any(math.isnan(r["ci_lo"]) for r in out.collect())


def test_cv_scores_resamples_each_fold_once(spark):
    """The fit and whatever it scans read stored rows: a resampled row is made once."""
    df = spark.createDataFrame([(i, float(i % 7), i % 2, i % 3) for i in range(60)], "id int, x double, label int, fold int")
    made = spark.sparkContext.accumulator(0)

    def resample(rows):
        def count(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b
        return rows.mapInArrow(count, rows.schema)

    out = tune.cv_scores(lambda: models.pipeline(["x"], models.logistic(1.0, 60, 5)), df, "id", "label", 3, resample=resample)
    assert out.count() == 3 and made.value == 120
