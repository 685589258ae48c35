"""Neighbour joins, KNN classification and SMOTE queries (J2, J3, M9, V11,
A18, R1–R3, U1) on min-max scaled churn features."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.functions.hashing import duckdb_uniform, hash_uniform
from attrition.operators import clean, encode, neighbors, resample
from attrition.plans.registry import query
from attrition.sources.views import CHURN_SQL, churn_view, with_views

FEATS = ["c_acctbal", "n_orders", "spend", "n_prio"]
NOMINAL = ["r_name", "c_mktsegment"]
U = duckdb_uniform(42, "c_custkey")


def features(spark, sf_dir):
    """Churn rows without nulls, features min-max scaled over those rows."""
    cn = clean.dropna_any(churn_view(spark, sf_dir), FEATS)
    return encode.fit_minmax(cn, FEATS).transform(cn.select("c_custkey", *FEATS, *NOMINAL, "exited"))


FEAT_SQL = """
cn AS (SELECT * FROM churn WHERE c_acctbal IS NOT NULL AND n_orders IS NOT NULL
       AND spend IS NOT NULL AND n_prio IS NOT NULL),
st AS (SELECT """ + ", ".join(
    f"min(CAST({c} AS DOUBLE)) AS o_{c}, max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE)) AS s_{c}"
    for c in FEATS) + """ FROM cn),
feat AS (SELECT c_custkey, """ + ", ".join(
    f"(CAST({c} AS DOUBLE) - o_{c}) / s_{c} AS {c}" for c in FEATS) + """, r_name, c_mktsegment, exited
         FROM cn, st)"""


def _d2(a: str, b: str, metric: str = "euclidean", penalty: str | None = None) -> str:
    if metric == "euclidean":
        terms = [f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in FEATS]
    else:
        terms = [f"abs({a}.{c} - {b}.{c})" for c in FEATS]
    if penalty:
        terms += [f"CASE WHEN {a}.{c} <> {b}.{c} THEN {penalty} ELSE 0.0 END" for c in NOMINAL]
    return " + ".join(terms)


@query("knn_join", with_views(FEAT_SQL + f""",
m AS (SELECT * FROM feat WHERE exited = 1),
p AS (SELECT a.c_custkey, b.c_custkey AS nkey, {_d2('a', 'b')} AS d2
      FROM m a JOIN m b ON a.c_custkey <> b.c_custkey)
SELECT c_custkey, CAST(rank AS INTEGER) AS rank, nkey, round(sqrt(d2), 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, nkey) AS rank FROM p) WHERE rank <= 5""",
    CHURN_SQL), ops="J2")
def knn_join(spark, sf_dir):
    m = features(spark, sf_dir).where(F.col("exited") == 1)
    return neighbors.knn(m, m, "c_custkey", "c_custkey", FEATS, 5, self_join=True)


def _split(spark, sf_dir):
    f = features(spark, sf_dir)
    u = hash_uniform(42, "c_custkey")
    return f.where(u >= 0.3), f.where(u < 0.3)


def _knn_pairs_sql(metric: str, k: int) -> str:
    return FEAT_SQL + f""",
tr AS (SELECT * FROM feat WHERE {U} >= 0.3),
te AS (SELECT * FROM feat WHERE {U} < 0.3),
p AS (SELECT a.c_custkey, b.c_custkey AS nkey, b.exited AS nl, {_d2('a', 'b', metric)} AS d2
      FROM te a, tr b),
nn AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, nkey) AS rank FROM p
       QUALIFY rank <= {k})"""


def _vote_sql(weight: str) -> str:
    return f"""
v AS (SELECT c_custkey, nl, sum({weight}) AS votes FROM nn GROUP BY c_custkey, nl)
SELECT c_custkey, CAST(arg_min(nl, (-votes, nl)) AS INTEGER) AS pred,
       round(sum(CASE WHEN nl = 1 THEN votes ELSE 0.0 END) / sum(votes), 6) AS p
FROM v GROUP BY c_custkey"""


@query("knn_classify_uniform", with_views(_knn_pairs_sql("euclidean", 5) + "," + _vote_sql("1.0"), CHURN_SQL),
       ops="M9 J3")
def knn_classify_uniform(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return neighbors.knn_classify(tr, te, "c_custkey", "exited", FEATS, 5)


@query("knn_classify_distance", with_views(
    _knn_pairs_sql("euclidean", 5) + """,
nz AS (SELECT *, min(d2) OVER (PARTITION BY c_custkey) = 0 AS has_zero FROM nn),""" + _vote_sql(
        "CASE WHEN has_zero THEN CAST(d2 = 0 AS DOUBLE) ELSE 1.0 / sqrt(d2) END").replace(
        "FROM nn GROUP BY c_custkey, nl", "FROM nz GROUP BY c_custkey, nl"), CHURN_SQL), ops="M9 J3")
def knn_classify_distance(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return neighbors.knn_classify(tr, te, "c_custkey", "exited", FEATS, 5, weights="distance")


@query("knn_classify_manhattan", with_views(_knn_pairs_sql("manhattan", 5) + "," + _vote_sql("1.0"), CHURN_SQL),
       ops="M9 J3")
def knn_classify_manhattan(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return neighbors.knn_classify(tr, te, "c_custkey", "exited", FEATS, 5, metric="manhattan")


CURVE_SQL = _knn_pairs_sql("euclidean", 15) + """,
r AS (SELECT c_custkey, rank, sum(nl) OVER (PARTITION BY c_custkey ORDER BY rank) AS ones FROM nn),
e AS (SELECT CAST(r.rank AS INTEGER) AS k,
             avg(CAST(CAST(ones > r.rank - ones AS INTEGER) <> te.exited AS INTEGER)) AS error
      FROM r JOIN te ON r.c_custkey = te.c_custkey GROUP BY r.rank)"""


@query("knn_error_curve", with_views(CURVE_SQL + "\nSELECT k, round(error, 6) AS error FROM e", CHURN_SQL),
       ops="V11 A18")
def knn_error_curve(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return neighbors.knn_error_curve(tr, te, "c_custkey", "exited", FEATS, 15)


@query("knn_best_k", with_views(CURVE_SQL + "\nSELECT k, round(error, 6) AS error FROM e ORDER BY error, k LIMIT 1",
                                CHURN_SQL), ops="V11 W3")
def knn_best_k(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return neighbors.best_k(neighbors.knn_error_curve(tr, te, "c_custkey", "exited", FEATS, 15))


def _smote_sql(ratio: float | None = None, nominal: bool = False) -> str:
    target = "n_major" if ratio is None else f"CAST(floor({ratio} * n_major) AS BIGINT)"
    pen = "pen.penalty" if nominal else None
    nom_cols = ", r_name, c_mktsegment" if nominal else ""
    pen_cte = ""
    if nominal:
        pen_cte = """
sd AS (SELECT """ + ", ".join(f"stddev_pop({c}) AS {c}" for c in FEATS) + """ FROM m),
sdl AS (UNPIVOT sd ON """ + ", ".join(FEATS) + """ INTO NAME f VALUE s),
pen AS (SELECT quantile_cont(s, 0.5) * quantile_cont(s, 0.5) AS penalty FROM sdl),"""
    u_ord = duckdb_uniform(42, "c_custkey", "'order'")
    u_nn = duckdb_uniform(42, "c_custkey", "syn_idx", "'nn'")
    u_gap = duckdb_uniform(42, "c_custkey", "syn_idx", "'gap'")
    sql = FEAT_SQL + f""",
m AS (SELECT * FROM feat WHERE exited = 1),
cnt AS (SELECT count(*) FILTER (WHERE exited = 1) AS m_n, count(*) FILTER (WHERE exited = 0) AS n_major FROM feat),
need AS (SELECT greatest({target} - m_n, 0) AS need, m_n FROM cnt),{pen_cte}
p AS (SELECT a.c_custkey, b.c_custkey AS nkey, {_d2('a', 'b', 'euclidean', pen)} AS d2
      FROM m a JOIN m b ON a.c_custkey <> b.c_custkey{', pen' if nominal else ''}),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d2, nkey) AS rank FROM p)
       WHERE rank <= 5),
o AS (SELECT m.*, row_number() OVER (ORDER BY {u_ord}, c_custkey) - 1 AS ord FROM m),
cp AS (SELECT o.*, unnest(range(need // m_n + CAST(ord < need % m_n AS BIGINT))) AS syn_idx FROM o, need),
cp2 AS (SELECT *, CAST(floor({u_nn} * 5) + 1 AS BIGINT) AS nn_rank, {u_gap} AS gap FROM cp),
syn AS (SELECT cp2.c_custkey, CAST(cp2.syn_idx AS INTEGER) AS syn_idx, 1 AS is_synthetic, """ + ", ".join(
        f"round(cp2.{c} + cp2.gap * (nb.{c} - cp2.{c}), 6) AS {c}" for c in FEATS) + f"""
        FROM cp2 JOIN nn ON cp2.c_custkey = nn.c_custkey AND cp2.nn_rank = nn.rank
        JOIN m nb ON nb.c_custkey = nn.nkey)"""
    if nominal:
        sql += """,
nv AS (SELECT nn.c_custkey, 'r_name' AS c, nb.r_name AS v FROM nn JOIN m nb ON nb.c_custkey = nn.nkey
       UNION ALL SELECT nn.c_custkey, 'c_mktsegment', nb.c_mktsegment FROM nn JOIN m nb ON nb.c_custkey = nn.nkey),
nc AS (SELECT c_custkey, c, v, count(*) AS cnt FROM nv GROUP BY ALL),
md AS (SELECT c_custkey, c, arg_min(v, (-cnt, v)) AS v FROM nc GROUP BY c_custkey, c),
mode AS (SELECT c_custkey, max(v) FILTER (WHERE c = 'r_name') AS r_name,
                max(v) FILTER (WHERE c = 'c_mktsegment') AS c_mktsegment FROM md GROUP BY c_custkey)
SELECT syn.*, mode.r_name, mode.c_mktsegment, 1 AS exited FROM syn JOIN mode USING (c_custkey)
UNION ALL SELECT c_custkey, NULL, 0, """ + ", ".join(f"round({c}, 6)" for c in FEATS) + \
            ", r_name, c_mktsegment, exited FROM feat"
    else:
        sql += """
SELECT syn.*, 1 AS exited FROM syn
UNION ALL SELECT c_custkey, NULL, 0, """ + ", ".join(f"round({c}, 6)" for c in FEATS) + \
            ", exited FROM feat"
    return with_views(sql, CHURN_SQL)


@query("smote_full", _smote_sql(), ops="R1 J2 U1")
def smote_full(spark, sf_dir):
    return resample.smote(features(spark, sf_dir), "c_custkey", "exited", FEATS, k=5, seed=42)


@query("smote_ratio", _smote_sql(ratio=0.6), ops="R2 J2 U1")
def smote_ratio(spark, sf_dir):
    return resample.smote(features(spark, sf_dir), "c_custkey", "exited", FEATS, k=5, seed=42, ratio=0.6)


@query("smotenc", _smote_sql(nominal=True), ops="R3 J2 U1")
def smotenc(spark, sf_dir):
    return resample.smote(features(spark, sf_dir), "c_custkey", "exited", FEATS, k=5, seed=42,
                          nominal=NOMINAL)


@query("smote_class_counts",
       f"SELECT exited, is_synthetic, count(*) AS n FROM ({_smote_sql()}) GROUP BY ALL", ops="A6 R1 U1")
def smote_class_counts(spark, sf_dir):
    s = resample.smote(features(spark, sf_dir), "c_custkey", "exited", FEATS, k=5, seed=42)
    return s.groupBy("exited", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))
