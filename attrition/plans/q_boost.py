"""Boosting with an exact twin in SQL: the splits of the first leaf-wise trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import boost
from attrition.plans.registry import query
from attrition.sources.views import LINE_SQL, line_key_col, line_view, with_views

FEATS = ["l_quantity", "l_discount", "l_tax"]
PARAMS = boost.Boosting(rounds=2, learning_rate=0.3, num_leaves=5, min_child_samples=40, min_child_weight=2.66,
                        reg_alpha=5.834, reg_lambda=1.478)


def _sql(p: boost.Boosting) -> str:
    """Best-first growth, a split after the other: every value of every feature is tried
    in every leaf, and the best one of all leaves is taken."""
    def t(g):
        return f"sign({g}) * greatest(abs({g}) - {p.reg_alpha}, 0)"

    def part(g, h):
        return f"pow({t(g)}, 2) / ({h} + {p.reg_lambda})"

    def value(g, h):
        return f"-({t(g)}) / ({h} + {p.reg_lambda}) * {p.learning_rate}"

    ctes, table = [], []
    names = ", ".join(FEATS)
    ctes.append(f"m0 AS MATERIALIZED (SELECT {names}, label, ln(avg(label) OVER () / (1 - avg(label) OVER ())) AS m FROM line)")
    for r in range(p.rounds):
        ctes.append(f"a{r}_0 AS MATERIALIZED (SELECT *, 1 / (1 + exp(-m)) - label AS g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) AS h, 0 AS node FROM m{r})")
        for s in range(p.num_leaves - 1):
            now = f"a{r}_{s}"
            ctes.append(f"h{r}_{s} AS (" + " UNION ALL ".join(
                f"SELECT node, {i} AS f, {c} AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {now} GROUP BY node, {c}" for i, c in enumerate(FEATS)) + ")")
            ctes.append(f"""c{r}_{s} AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
    sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(n) OVER a AS na FROM h{r}_{s} WINDOW w AS (PARTITION BY node, f ORDER BY v), a AS (PARTITION BY node, f))""")
            ctes.append(f"""b{r}_{s} AS MATERIALIZED (SELECT *, {part('gl', 'hl')} + {part('(ga - gl)', '(ha - hl)')} - {part('ga', 'ha')} AS gain,
    {value('gl', 'hl')} AS vl, {value('(ga - gl)', '(ha - hl)')} AS vr FROM c{r}_{s}
  WHERE least(nl, na - nl) >= {p.min_child_samples} AND least(hl, ha - hl) >= {p.min_child_weight}
  ORDER BY round(gain, 9) DESC, node, f, v LIMIT 1)""")
            side = "CASE " + " ".join(f"WHEN b.f = {i} THEN {c} <= b.v" for i, c in enumerate(FEATS)) + " END"
            ctes.append(f"a{r}_{s + 1} AS MATERIALIZED (SELECT {names}, label, m, a.g, a.h, CASE WHEN a.node <> b.node THEN a.node "
                        f"WHEN {side} THEN {2 * s + 1} ELSE {2 * s + 2} END AS node FROM {now} a, b{r}_{s} b)")
            later = " UNION ALL ".join([f"SELECT node FROM b{r}_{k}" for k in range(s + 1, p.num_leaves - 1)] or ["SELECT -1 AS node"])
            feature = "CASE " + " ".join(f"WHEN f = {i} THEN '{c}'" for i, c in enumerate(FEATS)) + " END"
            table.append(f"""SELECT 0 AS fit, {r} AS round, {s} AS step, {feature} AS feature, round(v::DOUBLE, 6) AS threshold, round(gain, 6) AS gain,
  nl::BIGINT AS n_left, (na - nl)::BIGINT AS n_right,
  CASE WHEN {2 * s + 1} NOT IN (SELECT node FROM l{r}_{s}) THEN round(vl, 6) END AS value_left,
  CASE WHEN {2 * s + 2} NOT IN (SELECT node FROM l{r}_{s}) THEN round(vr, 6) END AS value_right FROM b{r}_{s}""")
            ctes.append((f"l{r}_{s}", later))
        last = f"a{r}_{p.num_leaves - 1}"
        ctes.append(f"v{r} AS (SELECT node, {value('sum(g)', 'sum(h)')} AS v FROM {last} GROUP BY node)")
        ctes.append(f"m{r + 1} AS MATERIALIZED (SELECT {names}, label, m + v AS m FROM {last} JOIN v{r} USING (node))")
    # what is split later stands after the splits themselves
    late = [f"{n} AS ({q})" for n, q in (c for c in ctes if isinstance(c, tuple))]
    return ",\n".join([c for c in ctes if isinstance(c, str)] + late) + "\n" + "\nUNION ALL\n".join(table)


@query("leafwise_splits", with_views(_sql(PARAMS), LINE_SQL), ops="M6 M5 M4")
def leafwise_splits(spark, sf_dir):
    """Two rounds of leaf-wise boosting with L1 and L2 terms: every split and leaf value."""
    li = line_view(spark, sf_dir).select(line_key_col().alias("row_key"), *FEATS, F.col("label").cast("int").alias("label"))
    return boost.split_table(spark, boost.fit_many(li, "row_key", FEATS, "label", PARAMS))
