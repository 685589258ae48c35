"""Studies with an exact twin in SQL: the neighbour grid and its winner (T1, T3, V9,
M9), Newton steps (M1), k-means for all k (M10, V12), bootstrap intervals (A13) and
ordered target statistics (M7)."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from attrition.functions.hashing import duckdb_uniform, hash_uniform
from attrition.operators import encode, knn_grid, newton, profile, segment, split
from attrition.plans.q_neighbors import FEAT_SQL, FEATS, features
from attrition.plans.registry import query
from attrition.sources.views import CHURN_SQL, churn_view, with_views

# --- T1, V9, T3: neighbour grid ------------------------------------------------------

#: The workload's grid (k, folds) and study (k, folds).
GRID_K, GRID_FOLDS = 16, 5
STUDY_K, STUDY_FOLDS = 30, 10
U, U_FOLD = duckdb_uniform(42, "c_custkey"), duckdb_uniform(42, "c_custkey", "'fold'")


def _d2(metric: str) -> str:
    return " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" if metric == "euclidean" else f"abs(a.{c} - b.{c})" for c in FEATS)


def _voted_sql(name: str, queries: str, refs: str, on: str, metric: str, k_max: int) -> str:
    """CTEs ending in ``name`` (c_custkey, run, y, k, weights, p, pred)."""
    dist = "sqrt(d2)" if metric == "euclidean" else "d2"
    return f"""
{name}_p AS (SELECT a.c_custkey, a.run, a.exited AS y, b.c_custkey AS nkey, b.exited AS nl, {_d2(metric)} AS d2 FROM {queries} a JOIN {refs} b ON {on}),
{name}_n AS (SELECT *, {dist} AS dist, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, nkey) AS k FROM {name}_p QUALIFY k <= {k_max}),
{name}_w AS (SELECT *, CASE WHEN min(dist) OVER (PARTITION BY c_custkey) = 0 THEN CAST(dist = 0 AS DOUBLE) ELSE 1.0 / dist END AS w FROM {name}_n),
{name}_s AS (SELECT c_custkey, run, y, k, sum(nl) OVER o / k AS up, sum(w * nl) OVER o / sum(w) OVER o AS dp FROM {name}_w
  WINDOW o AS (PARTITION BY c_custkey ORDER BY k ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT c_custkey, run, y, k, weights, p, CAST(round(p - 0.5, 9) > 0 AS INTEGER) AS pred FROM (
  SELECT c_custkey, run, y, k, 'uniform' AS weights, up AS p FROM {name}_s UNION ALL SELECT c_custkey, run, y, k, 'distance', dp FROM {name}_s))"""


def _scores_sql(voted: str, by: str) -> str:
    return f"""SELECT {by}, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
    coalesce(2 * tp / nullif(2.0 * tp + fp + fn, 0), 0) AS f1, coalesce(2 * tn / nullif(2.0 * tn + fp + fn, 0), 0) AS f0,
    coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall FROM (
  SELECT {by}, count(*) FILTER (WHERE y = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1)::DOUBLE AS fp,
    count(*) FILTER (WHERE y = 1 AND pred = 0)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0)::DOUBLE AS tn FROM {voted} GROUP BY {by})"""


def _grid_sql(k_max: int, folds: int) -> str:
    parts = []
    for m in ("euclidean", "manhattan"):
        parts.append(_voted_sql(f"v_{m}", "tr", "tr", "a.run <> b.run", m, k_max))
        parts.append(f"s_{m} AS ({_scores_sql(f'v_{m}', 'weights, k, run')})")
    cells = " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, weights, CAST(k AS INTEGER) AS k, avg(accuracy) AS accuracy_mean, stddev_pop(accuracy) AS accuracy_std,
  avg((f1 + f0) / 2) AS macro_f1_mean, stddev_pop((f1 + f0) / 2) AS macro_f1_std, count(*) AS n_folds FROM s_{m} GROUP BY weights, k"""
        for m in ("euclidean", "manhattan"))
    return FEAT_SQL + f""",
tr AS (SELECT *, CAST(floor({U_FOLD} * {folds}) AS INTEGER) AS run FROM feat WHERE {U} >= 0.3),
te AS (SELECT *, 0 AS run FROM feat WHERE {U} < 0.3),""" + ",\n".join(parts) + f",\ncells AS ({cells})"


def _train_test(spark, sf_dir, folds):
    f = features(spark, sf_dir)
    u = hash_uniform(42, "c_custkey")
    return split.kfold_hash(f.where(u >= 0.3), "c_custkey", folds, 42), f.where(u < 0.3)


def _grid(train, k_max, folds):
    return knn_grid.cv_grid(train, "c_custkey", "exited", FEATS, "fold", folds, k_max)


CELL = ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy_mean", "accuracy_std", "macro_f1_mean", "macro_f1_std"))


@query("knn_grid", with_views(_grid_sql(GRID_K, GRID_FOLDS) + f"\nSELECT metric, weights, k, {CELL}, n_folds FROM cells", CHURN_SQL), ops="T1 V9 M9")
def knn_grid_query(spark, sf_dir):
    """All cells of the neighbour grid (a Minkowski metric of order 2 is the Euclidean one)."""
    train, _ = _train_test(spark, sf_dir, GRID_FOLDS)
    return _grid(train, GRID_K, GRID_FOLDS)


def _study_sql() -> str:
    reports = []
    ctes = [_grid_sql(STUDY_K, STUDY_FOLDS),
            "best AS MATERIALIZED (SELECT * FROM cells ORDER BY round(macro_f1_mean, 9) DESC, metric, weights, k LIMIT 1)"]
    for m in ("euclidean", "manhattan"):
        ctes.append(_voted_sql(f"t_{m}", "te", "tr", "true", m, STUDY_K))
        reports.append(f"SELECT t.* FROM t_{m} t, best WHERE best.metric = '{m}' AND t.k = best.k AND t.weights = best.weights")
    ctes.append("final AS (" + " UNION ALL ".join(reports) + ")")
    ctes.append(f"report AS ({_scores_sql('final', 'weights, k')})")
    return ",\n".join(ctes) + """
SELECT best.metric, best.weights, best.k, round(macro_f1_mean, 6) AS cv_macro_f1, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round((f1 + f0) / 2, 6) AS macro_f1 FROM best, report"""


@query("knn_study", with_views(_study_sql(), CHURN_SQL), ops="T1 T2 T3 V9 M9")
def knn_study(spark, sf_dir):
    """Best cell by macro F1 over ten folds, refitted on all training rows and
    reported on the hold-out."""
    train, test = _train_test(spark, sf_dir, STUDY_FOLDS)
    best = knn_grid.best_cell(_grid(train, STUDY_K, STUDY_FOLDS), "macro_f1_mean")
    voted = knn_grid.holdout_votes(train, test, "c_custkey", "exited", FEATS, best)
    cell = [F.lit(best["metric"]).alias("metric"), F.lit(best["weights"]).alias("weights"), F.lit(best["k"]).alias("k"),
            F.lit(float(best["macro_f1_mean"])).alias("cv_macro_f1")]
    return knn_grid.cell_scores(voted.withColumn("__all", F.lit(0)), "__all", "exited", []).drop("__all").select(*cell, "accuracy", "precision", "recall", "f1", "macro_f1")


# --- M1: Newton steps ------------------------------------------------------------------

LOGIT_FEATS, LOGIT_STEPS, LOGIT_L2 = ["c_acctbal", "spend", "n_prio"], 6, 1.0


def _det(m: list[list[str]]) -> str:
    terms = []
    for p in permutations(range(len(m))):
        swaps = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
        terms.append(("-" if swaps % 2 else "+") + " " + " * ".join(m[i][p[i]] for i in range(len(p))))
    return "(" + " ".join(terms) + ")"


def _newton_sql() -> str:
    d = len(LOGIT_FEATS) + 1
    x = ["1.0", *[f"f.{c}" for c in LOGIT_FEATS]]
    ctes = ["b0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(d)) + ")"]
    out = []
    for s in range(LOGIT_STEPS):
        z = " + ".join(f"b.b{i} * {x[i]}" for i in range(d))
        ctes.append(f"z{s} AS (SELECT f.*, {z} AS z, 1.0 / (1.0 + exp(-({z}))) AS p FROM feat f, b{s} b)")
        sums = [f"sum((f.exited - p) * {x[i]}) AS g{i}" for i in range(d)]
        sums += [f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(d) for j in range(i, d)]
        loss = "sum(greatest(z, 0) + ln(1 + exp(-abs(z))) - exited * z) AS loss"
        ctes.append(f"s{s} AS (SELECT {', '.join(sums)}, {loss} FROM z{s} f)")
        h = [[f"(s.h{min(i, j)}_{max(i, j)}{f' + {LOGIT_L2}' if i == j and i else ''})" for j in range(d)] for i in range(d)]
        g = [f"(s.g{i}{f' - {LOGIT_L2} * b.b{i}' if i else ''})" for i in range(d)]
        new = []
        for c in range(d):
            swapped = [[g[i] if j == c else h[i][j] for j in range(d)] for i in range(d)]
            new.append(f"b.b{c} + {_det(swapped)} / {_det(h)} AS b{c}")
        ctes.append(f"b{s + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM b{s} b, s{s} s)")
        for i, name in enumerate(["(intercept)", *LOGIT_FEATS]):
            out.append(f"SELECT {s + 1} AS step, '{name}' AS feature, round(b.b{i}, 6) AS coef, round(s.loss, 6) AS loss_before FROM b{s + 1} b, s{s} s")
    return FEAT_SQL + ",\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(out)


@query("logit_newton", with_views(_newton_sql(), CHURN_SQL), ops="M1")
def logit_newton(spark, sf_dir):
    """Intercept and coefficients after each of six Newton steps (C = 1)."""
    fit = newton.fit_logistic(features(spark, sf_dir), LOGIT_FEATS, "exited", LOGIT_L2, max_steps=LOGIT_STEPS, tol=0.0)
    rows = [(s + 1, name, float(b), loss) for s, (beta, loss) in enumerate(fit.path) for name, b in zip(["(intercept)", *LOGIT_FEATS], beta, strict=True)]
    return spark.createDataFrame(rows, "step int, feature string, coef double, loss_before double")


# --- M10, V12: all k at once -------------------------------------------------------------

KMEANS_STEPS, KMEANS_K = 6, 10


def _kmeans_sql() -> str:
    cols = ", ".join(FEATS)
    u = duckdb_uniform(42, "c_custkey")
    d2 = " + ".join(f"(f.{c} - c.{c}) * (f.{c} - c.{c})" for c in FEATS)
    ctes = [f"fr AS (SELECT {cols}, row_number() OVER (ORDER BY {u}, c_custkey) - 1 AS i FROM feat)",
            f"c0 AS (SELECT k, i, {cols} FROM fr, range(1, {KMEANS_K + 1}) t(k) WHERE i < k)"]
    for s in range(KMEANS_STEPS + 1):
        ctes.append(f"""n{s} AS MATERIALIZED (SELECT c_custkey, k, min((d2, i)) AS near FROM (
  SELECT f.c_custkey, c.k, c.i, {d2} AS d2 FROM feat f, c{s} c) GROUP BY ALL)""")
        if s < KMEANS_STEPS:
            avgs = ", ".join(f"avg({c}) AS {c}" for c in FEATS)
            kept = ", ".join(f"coalesce(m.{c}, c{s}.{c}) AS {c}" for c in FEATS)
            ctes.append(f"m{s} AS (SELECT k, near[2] AS i, {avgs} FROM n{s} JOIN feat USING (c_custkey) GROUP BY ALL)")
            ctes.append(f"c{s + 1} AS MATERIALIZED (SELECT k, i, {kept} FROM c{s} LEFT JOIN m{s} m USING (k, i))")
    return FEAT_SQL + ",\n" + ",\n".join(ctes) + f"\nSELECT CAST(k AS INTEGER) AS k, round(sum(near[1]), 6) AS sse FROM n{KMEANS_STEPS} GROUP BY k"


@query("kmeans_all_k", with_views(_kmeans_sql(), CHURN_SQL), ops="M10 V12")
def kmeans_all_k(spark, sf_dir):
    """SSE for k = 1..10 after six joint Lloyd steps from a hash-drawn start."""
    return segment.kmeans_all_k(features(spark, sf_dir), "c_custkey", FEATS, KMEANS_K, 42, KMEANS_STEPS)[0]


@query("kmeans_all_k_elbow", ops="M10 V12 W2 W3")
def kmeans_all_k_elbow(spark, sf_dir):
    """The same until no centre moves (300 steps at most, as the workload), on the churned
    customers, with the chosen k."""
    f = features(spark, sf_dir).where(F.col("exited") == 1)
    curve, _ = segment.kmeans_all_k(f, "c_custkey", FEATS, KMEANS_K)
    return curve.join(segment.choose_k(curve).withColumn("k", F.lit(1)), "k", "left")


# --- A13: bootstrap ------------------------------------------------------------------------

N_BOOT = 1000


def _bootstrap_sql() -> str:
    u = f"CAST(('0x' || substr(md5(concat_ws('|', '42', CAST(c_custkey AS VARCHAR), CAST(r // 4 AS VARCHAR))), CAST(8 * (r % 4) + 1 AS INTEGER), 8)) AS UBIGINT) / {2 ** 32}.0::DOUBLE"
    times = " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INTEGER)" for c in profile.POISSON_CDF)
    return f"""
x AS (SELECT c_custkey, r_name, CAST(c_acctbal AS DOUBLE) AS x FROM churn WHERE c_acctbal IS NOT NULL),
u AS (SELECT r_name, x, r, {u} AS u FROM x, range(0, {N_BOOT}) t(r)),
w AS (SELECT r_name, x, r, {times} AS w FROM u),
b AS (SELECT r_name, r, sum(w * x) / sum(w) AS m FROM w GROUP BY r_name, r HAVING sum(w) > 0),
ci AS (SELECT r_name, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, count(*) AS n_boot FROM b GROUP BY r_name)
SELECT r_name, round(avg(x), 6) AS mean, count(*) AS n, round(any_value(lo), 6) AS ci_lo, round(any_value(hi), 6) AS ci_hi,
  any_value(n_boot) AS n_boot FROM x JOIN ci USING (r_name) GROUP BY r_name"""


@query("bootstrap_mean_ci", with_views(_bootstrap_sql(), CHURN_SQL), ops="A13")
def bootstrap_mean_ci(spark, sf_dir):
    """Mean balance per region with a percentile bootstrap interval of 1000 replicates."""
    return profile.bootstrap_mean_ci(churn_view(spark, sf_dir), "c_custkey", "r_name", "c_acctbal", N_BOOT)


# --- M7: ordered target statistics ------------------------------------------------------------

U_ORDER = duckdb_uniform(42, "c_custkey", "'order'")
TS_LEVELS = ["r_name", "c_mktsegment"]


@query("ordered_target_stats", with_views(f"""
o AS (SELECT c_custkey, r_name, c_mktsegment, exited, {U_ORDER} AS u, avg(exited) OVER () AS p FROM churn)
SELECT c_custkey, """ + ", ".join(
    f"""round((coalesce(sum(exited) OVER w{i}, 0) + p) / (count(*) OVER w{i} + 1), 6) AS {c}__ts""" for i, c in enumerate(TS_LEVELS)) + """ FROM o WINDOW """ + ", ".join(
    f"w{i} AS (PARTITION BY {c} ORDER BY u, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for i, c in enumerate(TS_LEVELS)), CHURN_SQL), ops="M7 E1")
def ordered_target_stats(spark, sf_dir):
    """Nominal columns as the churn rate of the level's earlier rows."""
    out = encode.ordered_target_stats(churn_view(spark, sf_dir), "c_custkey", "exited", TS_LEVELS)
    return out.select("c_custkey", *[f"{c}__ts" for c in TS_LEVELS])
