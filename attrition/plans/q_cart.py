"""Exact trees with their twin in SQL: splits, hold-out report, attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.functions.hashing import duckdb_uniform, hash_uniform
from attrition.operators import cart, clean
from attrition.operators.profile import POISSON_CDF
from attrition.plans.registry import query
from attrition.sources.views import CHURN_SQL, churn_view, with_views

FEATS = ["c_acctbal", "n_orders", "spend", "n_prio"]
#: The workload's tree and its threshold; log2 of four features is two.
TREE = cart.Cart(max_depth=5, min_samples_split=23, min_samples_leaf=17, max_features=2, class_weight=(1.0, 8.61))
THRESHOLD = 0.56
#: Ten trees of four levels: the SQL twin spells out every level.
FOREST = cart.Cart(max_depth=4, min_samples_leaf=5, max_features=2, trees=10, bootstrap=True)
U = duckdb_uniform(42, "c_custkey")


def _levels_sql(p: cart.Cart) -> str:
    """CTEs: tr and te (the split rows), b0, b1, … (a level's splits), splits, leaf_of."""
    def imp(n, n1):
        a, b = f"({n} - {n1}) * {p.class_weight[0]}::DOUBLE", f"{n1} * {p.class_weight[1]}::DOUBLE"
        return f"2 * ({a}) * ({b}) / (({a}) + ({b}))"

    bag = duckdb_uniform(p.seed, "c_custkey", "tree", "'bag'")
    times = "1" if not p.bootstrap else " + ".join(f"CAST({bag} >= {c!r}::DOUBLE AS INTEGER)" for c in POISSON_CDF)
    draw = duckdb_uniform(p.seed, "tree", "node", "f")
    names = ", ".join(FEATS)
    value = "CASE b.f " + " ".join(f"WHEN {i} THEN r.{c}" for i, c in enumerate(FEATS)) + " END"
    cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATS)
    ctes = [f"cn AS MATERIALIZED (SELECT c_custkey, {cast}, exited AS y FROM churn WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATS) + ")",
            f"te AS (SELECT * FROM cn WHERE {U} < 0.3)",
            f"r0 AS MATERIALIZED (SELECT * FROM (SELECT CAST(tree AS INTEGER) AS tree, 1::BIGINT AS node, {names}, y, {times} AS m "
            f"FROM cn, range(0, {p.trees}) t(tree) WHERE {U} >= 0.3) WHERE m > 0)"]
    for lv in range(p.max_depth):
        ctes.append(f"h{lv} AS (SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT tree, node, {i} AS f, {c} AS v, sum(m)::BIGINT AS n, sum(m * y)::BIGINT AS n1 FROM r{lv} GROUP BY ALL" for i, c in enumerate(FEATS))
            + f") QUALIFY dense_rank() OVER (PARTITION BY tree, node ORDER BY {draw}, f) <= {p.max_features or len(FEATS)})")
        ctes.append(f"""c{lv} AS (SELECT tree, node, f, v, (sum(n) OVER o)::BIGINT AS nl, (sum(n1) OVER o)::BIGINT AS n1l, (sum(n) OVER a)::BIGINT AS n,
    (sum(n1) OVER a)::BIGINT AS n1, lead(v) OVER o AS above FROM h{lv} WINDOW a AS (PARTITION BY tree, node, f), o AS (PARTITION BY tree, node, f ORDER BY v))""")
        ctes.append(f"""b{lv} AS MATERIALIZED (SELECT *, {imp('n', 'n1')} - {imp('nl', 'n1l')} - {imp('(n - nl)', '(n1 - n1l)')} AS gain FROM c{lv}
  WHERE n >= {p.min_samples_split} AND n1 > 0 AND n1 < n AND least(nl, n - nl) >= {max(p.min_samples_leaf, 1)}
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY round(gain, 9) DESC, f, v) = 1)""")
        ctes.append(f"r{lv + 1} AS MATERIALIZED (SELECT r.tree, 2 * r.node + CAST({value} > b.v AS BIGINT) AS node, {', '.join(f'r.{c}' for c in FEATS)}, y, m "
                    f"FROM r{lv} r JOIN b{lv} b USING (tree, node))")
    ctes.append("splits AS (" + " UNION ALL ".join(f"SELECT * FROM b{lv}" for lv in range(p.max_depth)) + ")")
    ctes.append("""nodes AS (SELECT tree, node, sum(m) AS n, sum(m * y) AS n1 FROM r0 GROUP BY ALL UNION ALL
  SELECT tree, 2 * node, nl, n1l FROM splits UNION ALL SELECT tree, 2 * node + 1, n - nl, n1 - n1l FROM splits)""")
    ctes.append(f"w0 AS (SELECT c_custkey, {names}, y, CAST(tree AS INTEGER) AS tree, 1::BIGINT AS node FROM te, range(0, {p.trees}) t(tree))")
    for lv in range(p.max_depth):
        ctes.append(f"w{lv + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (node), CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + CAST({value} > b.v + (b.above - b.v) / 2 AS BIGINT) END AS node "
                    f"FROM w{lv} r LEFT JOIN b{lv} b USING (tree, node))")
    a, b = f"(n - n1) * {p.class_weight[0]}::DOUBLE", f"n1 * {p.class_weight[1]}::DOUBLE"
    ctes.append(f"scored AS (SELECT c_custkey, any_value(y) AS y, avg(({b}) / (({a}) + ({b}))) AS prob FROM w{p.max_depth} JOIN nodes USING (tree, node) GROUP BY c_custkey)")
    return ",\n".join(ctes)


_NAMED = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATS)) + " END"
SPLITS_SQL = f"""
SELECT tree, node, {_NAMED} AS feature, round(v + (above - v) / 2, 6) AS threshold, round(gain, 6) AS gain, n, n1, nl AS n_left, n1l AS n1_left FROM splits"""


def _split(spark, sf_dir):
    rows = clean.dropna_any(churn_view(spark, sf_dir), FEATS)
    u = hash_uniform(42, "c_custkey")
    return rows.where(u >= 0.3), rows.where(u < 0.3)


def _fitted(spark, sf_dir, p):
    train, test = _split(spark, sf_dir)
    return cart.fit(train, "c_custkey", FEATS, "exited", p), test


def _named(splits):
    return splits.select("tree", "node", F.get(F.array(*map(F.lit, FEATS)), F.col("f")).alias("feature"), "threshold", "gain", "n", "n1", "n_left", "n1_left")


@query("cart_splits", with_views(_levels_sql(TREE) + SPLITS_SQL, CHURN_SQL), ops="M2")
def cart_splits(spark, sf_dir):
    """Every split of the workload's tree, found over all distinct values."""
    return _named(_fitted(spark, sf_dir, TREE)[0][0])


@query("cart_report", with_views(_levels_sql(TREE) + f"""
SELECT count(*) FILTER (WHERE y = 1 AND prob >= {THRESHOLD}) AS tp, count(*) FILTER (WHERE y = 0 AND prob >= {THRESHOLD}) AS fp,
  count(*) FILTER (WHERE y = 1 AND prob < {THRESHOLD}) AS fn, count(*) FILTER (WHERE y = 0 AND prob < {THRESHOLD}) AS tn,
  round(avg(prob), 6) AS mean_prob FROM scored""", CHURN_SQL), ops="M2 P6 V1 T3")
def cart_report(spark, sf_dir):
    """The same tree on the hold-out at the workload's threshold."""
    model, test = _fitted(spark, sf_dir, TREE)
    scored = cart.score(test, FEATS, model, TREE)
    hit, y = F.col("prob") >= THRESHOLD, F.col("exited") == 1
    return scored.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"),
                      F.count_if(~y & ~hit).alias("tn"), F.avg("prob").alias("mean_prob"))


@query("cart_forest_splits", with_views(_levels_sql(FOREST) + SPLITS_SQL, CHURN_SQL), ops="M3")
def cart_forest_splits(spark, sf_dir):
    """Every split of ten bootstrapped trees, all grown in the same jobs."""
    return _named(_fitted(spark, sf_dir, FOREST)[0][0])


@query("cart_forest_scores", with_views(_levels_sql(FOREST) + "\nSELECT c_custkey, y AS exited, round(prob, 6) AS prob FROM scored", CHURN_SQL), ops="M3 M11")
def cart_forest_scores(spark, sf_dir):
    """The forest's hold-out scores."""
    model, test = _fitted(spark, sf_dir, FOREST)
    return cart.score(test, FEATS, model, FOREST).select("c_custkey", "exited", "prob")


@query("tree_attribution", ops="X1")
def tree_attribution(spark, sf_dir):
    """Exact Shapley values of every hold-out row under the workload's tree."""
    model, test = _fitted(spark, sf_dir, TREE)
    return cart.tree_attribution(test, "c_custkey", FEATS, model, TREE)
