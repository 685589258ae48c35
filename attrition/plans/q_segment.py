"""Segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import segment
from attrition.plans.q_neighbors import FEAT_SQL, FEATS, features
from attrition.plans.registry import query
from attrition.sources.views import CHURN_SQL, churn_view, with_views

CURVE_SQL = """
r AS (SELECT min(CAST(spend AS DOUBLE)) AS mn, max(CAST(spend AS DOUBLE)) AS mx FROM churn),
x AS (SELECT CAST(spend AS DOUBLE) AS x FROM churn WHERE spend IS NOT NULL),
kb AS (SELECT k.range AS k,
              CASE WHEN mx = mn THEN 0 ELSE least(floor((x - mn) * k.range / (mx - mn)), k.range - 1) END AS b, x
       FROM x, r, range(1, 11) k),
curve AS (SELECT k, sum(ss) AS sse FROM (SELECT k, b, var_pop(x) * count(*) AS ss FROM kb GROUP BY k, b)
          GROUP BY k),
c AS (SELECT k, sse, lead(sse) OVER (ORDER BY k) - sse AS next_drop,
             lag(sse) OVER (ORDER BY k) - 2 * sse + lead(sse) OVER (ORDER BY k) AS curv FROM curve)"""


@query("elbow_choice", with_views(CURVE_SQL + """
SELECT CAST(arg_min(k, (next_drop, k)) FILTER (WHERE k >= 2 AND next_drop IS NOT NULL) AS INTEGER) AS k_steepest,
       CAST(arg_min(k, (-curv, k)) FILTER (WHERE curv IS NOT NULL) AS INTEGER) AS k_curvature
FROM c""", CHURN_SQL), ops="V12 W2 W3")
def elbow_choice(spark, sf_dir):
    return segment.choose_k(segment.binned_sse_curve(churn_view(spark, sf_dir), "spend", 10))


def _centres(f):
    """Centres derived from the data: feature means per market segment
    (five rows), in segment order."""
    rows = sorted(f.groupBy("c_mktsegment").agg(*[F.avg(c).alias(c) for c in FEATS]).collect(),
                  key=lambda r: r["c_mktsegment"])
    return [[r[c] for c in FEATS] for r in rows]


def clustered(spark, sf_dir):
    f = features(spark, sf_dir)
    return segment.assign_nearest(f, FEATS, _centres(f))


ASSIGN_SQL = FEAT_SQL + """,
ce AS (SELECT row_number() OVER (ORDER BY c_mktsegment) - 1 AS i, """ + ", ".join(
    f"avg({c}) AS {c}" for c in FEATS) + """ FROM feat GROUP BY c_mktsegment),
d AS (SELECT f.*, ce.i, """ + " + ".join(f"(f.{c} - ce.{c}) * (f.{c} - ce.{c})" for c in FEATS) + """ AS d2
      FROM feat f, ce),
cl AS (SELECT c_custkey, CAST(arg_min(i, (d2, i)) AS INTEGER) AS cluster FROM d GROUP BY c_custkey),
fc AS (SELECT feat.*, cl.cluster FROM feat JOIN cl USING (c_custkey))"""


@query("nearest_centre", with_views(ASSIGN_SQL + "\nSELECT c_custkey, cluster FROM fc", CHURN_SQL), ops="J5")
def nearest_centre(spark, sf_dir):
    return clustered(spark, sf_dir).select("c_custkey", "cluster")


@query("cluster_rate", with_views(ASSIGN_SQL + """
SELECT cluster, round(avg(exited), 6) AS rate, count(*) AS n FROM fc GROUP BY cluster""", CHURN_SQL), ops="A7")
def cluster_rate(spark, sf_dir):
    return segment.cluster_rate(clustered(spark, sf_dir), "cluster", "exited")


@query("cluster_means", with_views(ASSIGN_SQL + "\nSELECT cluster, " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in FEATS + ["exited"]) + " FROM fc GROUP BY cluster", CHURN_SQL),
    ops="A8 P3")
def cluster_means(spark, sf_dir):
    return segment.cluster_means(clustered(spark, sf_dir), "cluster", exclude=("c_custkey",))


MODE_COLS = ["n_orders", "n_prio", "exited"]


@query("cluster_modes", with_views("""
cn AS (SELECT * FROM churn WHERE c_acctbal IS NOT NULL AND n_orders IS NOT NULL
       AND spend IS NOT NULL AND n_prio IS NOT NULL),
u AS (UNPIVOT (SELECT c_mktsegment, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MODE_COLS) + """ FROM cn)
      ON """ + ", ".join(MODE_COLS) + """ INTO NAME col VALUE v),
n AS (SELECT c_mktsegment, col, v, count(*) AS n FROM u GROUP BY ALL),
m AS (SELECT c_mktsegment, col, arg_min(v, (-n, v)) AS v FROM n GROUP BY c_mktsegment, col)
SELECT c_mktsegment, """ + ", ".join(f"max(v) FILTER (WHERE col = '{c}') AS {c}" for c in MODE_COLS) +
    " FROM m GROUP BY c_mktsegment", CHURN_SQL), ops="A9 G1")
def cluster_modes(spark, sf_dir):
    cn = churn_view(spark, sf_dir).na.drop(subset=FEATS)
    return segment.group_modes(cn, "c_mktsegment", MODE_COLS)


@query("kmeans_fit", ops="M10 A7")
def kmeans_fit(spark, sf_dir):
    """k-means (k = 4) on scaled churn features; churn rate per cluster."""
    f = features(spark, sf_dir)
    model, x = segment.fit_kmeans(f, FEATS, 4, seed=42)
    return segment.cluster_rate(model.transform(x), "cluster", "exited")


@query("kmeans_elbow", ops="V12 M10 W2 W3")
def kmeans_elbow(spark, sf_dir):
    """SSE for k = 1..10 on the churned customers only, and the chosen k."""
    f = features(spark, sf_dir).where(F.col("exited") == 1)
    curve = segment.elbow_curve(f, FEATS, 10, seed=42)
    return curve.join(segment.choose_k(curve).withColumn("k", F.lit(1)), "k", "left")
