"""Property tests on hand-made fixtures (micro tables built inline)."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import (clean, encode, explain, metrics, neighbors, ordinal, profile,
                                 quantiles, resample, segment, split)


def test_exact_percentiles_match_numpy(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([1.0, 2.0, 2.0, 3.5]) if i % 3 else rnd.random() * 100 for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = quantiles.exact_percentiles(df, "x", probs, bins=16)
    want = np.percentile(vals, [p * 100 for p in probs])
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_grouped_percentiles_hot_group(spark):
    rows = [("hot", float(i % 7)) for i in range(2000)] + [("cold", float(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = quantiles.grouped_percentiles(df, "x", [0.25, 0.5, 0.75], "g", bins=8)
    assert np.allclose(got["hot"], np.percentile([i % 7 for i in range(2000)], [25, 50, 75]))
    assert np.allclose(got["cold"], [2.5, 5.0, 7.5])


def test_qcut_duplicate_edges_dropped(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 50 + [1] * 30 + list(range(2, 22))], "x double")
    edges = profile.qcut_edges(df, "x", 10)
    assert edges == sorted(set(edges))
    binned = profile.qcut(df, "x", 10).collect()
    assert all(r["bin"] is not None and 0 <= r["bin"] < len(edges) - 1 for r in binned)
    zero_bins = {r["bin"] for r in binned if r["x"] == 0}
    assert zero_bins == {0}


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 2.0), (1, 3.0), (1, 2.0), (1, 5.0), (2, 7.0)], "g int, v double")
    m = {r["g"]: r["v"] for r in segment.group_modes(df, "g", ["v"]).collect()}
    assert m == {1: 2.0, 2: 7.0}


def test_constant_column_scaling(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "k int, c double, x double")
    mm = encode.fit_minmax(df, ["c", "x"]).transform(df).orderBy("k").collect()
    assert [r["c"] for r in mm] == [0.0, 0.0] and [r["x"] for r in mm] == [0.0, 1.0]
    st = encode.fit_standard(df, ["c", "x"]).transform(df).orderBy("k").collect()
    assert [r["c"] for r in st] == [0.0, 0.0] and [r["x"] for r in st] == [-1.0, 1.0]


def test_unseen_nominal(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    oh = encode.fit_one_hot(train, "c").transform(test).collect()
    assert [(r["c_a"], r["c_b"]) for r in oh] == [(1, 0), (0, 0)]
    with pytest.raises(Exception):
        encode.label_encode(train, ["c"], test).collect()


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = metrics.prf(df, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)


def test_no_threshold_meets_constraint(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1), (0, 0.8)], "y int, s double")
    curve = metrics.threshold_curve(df, "s", "y")
    best = metrics.best_threshold(curve, "recall", min_precision=0.99).first()
    assert (best["threshold"], best["value"]) == (0.5, 0.0)


def test_sweep_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    curve = {r["i"]: r for r in metrics.threshold_curve(df, "s", "y", 0.1, 0.9, 0.01).collect()}
    grid = np.arange(0.1, 0.9, 0.01)
    for i, t in enumerate(grid):
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        assert (curve[i]["tp"], curve[i]["fp"]) == (tp, fp)


def test_auc_ap_against_naive(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 20)) / 20) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    naive = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(df, "s", "y").first()[0] == pytest.approx(naive, abs=1e-12)
    ap = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        dr = sum(1 for y, s in rows if y == 1 and s == t) / len(pos)
        ap += dr * tp / (tp + fp)
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap, abs=1e-12)


def _brute_knn(pts, k, metric, self_join):
    out = {}
    for qi, qx in pts:
        cand = []
        for ri, rx in pts:
            if self_join and ri == qi:
                continue
            if metric == "euclidean":
                d = sum((a - b) * (a - b) for a, b in zip(qx, rx))
            else:
                d = sum(abs(a - b) for a, b in zip(qx, rx))
            cand.append((d, ri))
        out[qi] = [ri for _, ri in sorted(cand)[:k]]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_matches_brute_force_with_hot_duplicates(spark, metric):
    rnd = random.Random(5)
    pts = []
    for i in range(300):
        if i % 3 == 0:                               # a third of the rows are one point
            x = (0.5, 0.5, 0.5)
        else:
            x = (rnd.randint(0, 9) / 9, rnd.random(), rnd.randint(0, 3) / 3)
        pts.append((i, x))
    df = spark.createDataFrame([(i, *x) for i, x in pts], "id long, a double, b double, c double")
    nn = neighbors.knn(df, df, "id", "id", ["a", "b", "c"], 4, metric=metric, self_join=True, per_cell=8)
    got = {}
    for r in nn.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nkey"]))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert got == _brute_knn(pts, 4, metric, True)


def test_smote_properties(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.random(), rnd.random(), 1 if i % 4 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = resample.smote(df, "id", "y", ["a", "b"], k=3, seed=7)
    counts = {(r["y"], r["is_synthetic"]): r["count"] for r in out.groupBy("y", "is_synthetic").count().collect()}
    assert counts[(1, 0)] + counts[(1, 1)] == counts[(0, 0)]
    minority = {i: (a, b) for i, a, b, y in rows if y == 1}
    nn = {}
    for r in neighbors.knn(df.where("y = 1"), df.where("y = 1"), "id", "id", ["a", "b"], 3,
                           self_join=True).collect():
        nn.setdefault(r["id"], set()).add(r["nkey"])
    for r in out.where("is_synthetic = 1").collect():
        x = minority[r["id"]]
        ok = False
        for j in nn[r["id"]]:
            n = minority[j]
            g = (r["a"] - x[0]) / (n[0] - x[0]) if n[0] != x[0] else None
            if g is not None and 0 <= g < 1 and math.isclose(r["b"], x[1] + g * (n[1] - x[1]), abs_tol=1e-9):
                ok = True
        assert ok
    orig = out.where("is_synthetic = 0").select("id", "a", "b").collect()
    assert sorted((r["id"], r["a"], r["b"]) for r in orig) == sorted((i, a, b) for i, a, b, _ in rows)


def test_smote_minority_too_small(spark):
    df = spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 1), (3, 0.3, 0), (4, 0.5, 0), (5, 0.9, 0)],
                               "id long, a double, y int")
    with pytest.raises(ValueError):
        resample.smote(df, "id", "y", ["a"], k=5)


def test_split_is_partition_and_exact_quota(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    s = split.split_exact(df, "k", "y", 0.3).groupBy("y", "split").count().collect()
    c = {(r["y"], r["split"]): r["count"] for r in s}
    assert c[(1, "test")] == math.ceil(0.3 * 200) and c[(0, "test")] == math.ceil(0.3 * 800)
    assert sum(c.values()) == 1000
    h = split.split_hash(df, "k", 0.3)
    assert h.count() == 1000 and h.where("split = 'test'").count() in range(250, 350)


def test_dense_index_is_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    idx = ordinal.dense_index(df, ["k"], "i").collect()
    assert all(r["i"] == r["k"] for r in idx)


def test_duplicates_keep_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "a")], "k int, v string")
    assert sorted(r["k"] for r in clean.duplicate_rows(df, ["v"], "k").collect()) == [3, 5]
    assert sorted(r["k"] for r in clean.dedup_keep_first(df, ["v"], "k").collect()) == [1, 2]


def test_elbow_choosers_differ(spark):
    curve = spark.createDataFrame([(1, 100.0), (2, 60.0), (3, 50.0), (4, 10.0), (5, 8.0), (6, 7.0)],
                                  "k int, sse double")
    r = segment.choose_k(curve).first()
    assert r["k_steepest"] == 3          # largest drop from k=2 on: 50 → 10
    assert r["k_curvature"] == 4         # second difference 50-20+8 = 38 is the largest


def test_shapley_sums_to_prediction_gap(spark):
    from attrition.operators import models
    rnd = random.Random(8)
    rows = [(i, rnd.random(), rnd.random(), int(rnd.random() > 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    model = models.pipeline(["a", "b"], models.forest(5, 3)).fit(df)
    sample = df.where("id < 5")
    phi = explain.sampled_shapley(model, sample, df, "id", ["a", "b"], n_perm=4)
    tot = {r["id"]: r["s"] for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    p = {r["id"]: r["p"] for r in models.score(model, sample, "id").collect()}
    bg_ids = [r["id"] for r in df.withColumn("u", F.lit(0)).select("id").collect()]
    assert set(tot) == set(p) and len(bg_ids) == 200
    # every row: Σφ = f(x) − mean over the 4 background rows; same offset for all rows
    offsets = {round(p[i] - tot[i], 9) for i in tot}
    assert len(offsets) == 1


def test_nearest_centre_ties_lowest(spark):
    df = spark.createDataFrame([(0.5,), (0.0,)], "x double")
    out = segment.assign_nearest(df, ["x"], [[0.0], [1.0]]).collect()
    assert [r["cluster"] for r in out] == [0, 0]


def test_csv_scan_and_sinks(spark):
    from pyspark.ml import PipelineModel

    from attrition.operators import models
    from attrition.session import scratch_table_path
    from attrition.sources import tables
    src = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    csv_dir = scratch_table_path(spark, "csv")
    src.select("c_custkey", "c_acctbal", "c_mktsegment").write.option("header", True).csv(csv_dir)
    schema = "c_custkey long, c_acctbal double, c_mktsegment string"
    back = tables.read_csv(spark, csv_dir, schema=schema)
    assert back.count() == 150
    assert back.dtypes == [("c_custkey", "bigint"), ("c_acctbal", "double"), ("c_mktsegment", "string")]
    inferred = tables.read_csv(spark, csv_dir, key="row_key")
    assert inferred.columns[0] == "row_key" and dict(inferred.dtypes)["row_key"] in ("int", "bigint")
    rep = scratch_table_path(spark, "report")
    tables.write_report(back.groupBy("c_mktsegment").count(), rep)
    assert spark.read.parquet(rep).count() == 5
    df = src.withColumn("label", (F.col("c_acctbal") > 0).cast("int"))
    model = models.pipeline(["c_acctbal"], models.tree(2)).fit(df)
    path = scratch_table_path(spark, "model")
    tables.save_model(model, path)
    again = PipelineModel.load(path)
    assert again.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()


def test_paired_scan_rejects_mismatch(spark):
    from attrition.sources import tables
    a = spark.createDataFrame([(1, 2.0, 1)], "k long, x double, y int")
    b = spark.createDataFrame([(1, "z")], "k long, x string")
    with pytest.raises(ValueError):
        tables.paired_scan(a, b, "y")


def test_kde_binned_close_to_exact(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(rnd.gauss(0, 1),) for _ in range(5000)], "x double")
    ex = {r["i"]: r["density"] for r in profile.kde_grid(df, "x", 50).collect()}
    bn = {r["i"]: r["density"] for r in profile.kde_grid(df, "x", 50, method="binned").collect()}
    assert max(abs(ex[i] - bn[i]) for i in ex) < 1e-3 * max(ex.values())


def test_knn_with_codes_onehots_and_nominals_matches_brute_force(spark):
    """Columns of few values, hot vectors and all three kinds of distance."""
    import random

    from attrition.operators.neighbors import knn
    rng = random.Random(3)
    rows = []
    for i in range(260):
        c = rng.randrange(3)
        rows.append((i, rng.random(), rng.random() if i % 4 else 0.5, c / 2, float(c == 1), rng.choice("abc")))
    rows += [(1000 + i, 0.25, 0.5, 0.5, 1.0, "a") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, y double, code double, hot double, nom string")
    for metric, nominal, penalty in (("euclidean", [], 0.0), ("manhattan", [], 0.0), ("euclidean", ["nom"], 0.04), ("euclidean", ["nom"], 9.0)):
        got = {}
        for r in knn(df, df, "id", "id", ["x", "y", "code", "hot"], 4, metric, nominal, penalty, self_join=True).collect():
            got.setdefault(r["id"], []).append((r["rank"], r["nkey"]))
        for a in rows:
            def d(b, a=a):
                diffs = [abs(u - v) for u, v in zip(a[1:5], b[1:5])]
                s = sum(x * x for x in diffs) if metric == "euclidean" else sum(diffs)
                return s + (penalty if nominal and a[5] != b[5] else 0.0)
            want = sorted((round(d(b), 12), b[0]) for b in rows if b[0] != a[0])[:4]
            mine = [n for _, n in sorted(got[a[0]])]
            by_id = {b[0]: b for b in rows}
            assert [round(d(by_id[n]), 12) for n in mine] == [w for w, _ in want]
