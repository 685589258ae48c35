"""Profile queries (A1–A6, A10–A15) over the churn, line and order tables."""

from __future__ import annotations

from attrition.operators import profile
from attrition.plans.registry import query
from attrition.sources.tables import read_table
from attrition.sources.views import CHURN_SQL, churn_view, with_views

DECILES = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"


def _qcut_sql(view: str, col: str, label: str) -> str:
    return f"""
e AS (SELECT list_sort(list_distinct(quantile_cont({col}, {DECILES}))) AS edges
      FROM {view} WHERE {col} IS NOT NULL),
b AS (SELECT v.{label} AS lab, e.edges,
             len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < v.{col})) AS bin
      FROM {view} v, e WHERE v.{col} IS NOT NULL)
SELECT CAST(bin AS INTEGER) AS bin, round(edges[bin + 1], 6) AS bin_lo,
       round(edges[bin + 2], 6) AS bin_hi,
       count(*) FILTER (WHERE lab = 0) AS n_0, count(*) FILTER (WHERE lab = 1) AS n_1,
       round(count(*) FILTER (WHERE lab = 1) / count(*), 6) AS rate
FROM b GROUP BY bin, edges"""


@query("class_by_decile",
       with_views(_qcut_sql("churn", "spend", "exited"), CHURN_SQL),
       ops="S1 A3 A4")
def class_by_decile(spark, sf_dir):
    """Flagship: churn view → spend deciles → stayed/left counts and rate."""
    return profile.class_distribution(churn_view(spark, sf_dir), "spend", "exited", 10)


def _hist_sql(source: str, cols: list[str], bins: int) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"""
v AS (UNPIVOT (SELECT {casts} FROM {source}) ON {", ".join(cols)} INTO NAME "column" VALUE value),
r AS (SELECT "column", min(value) AS mn, max(value) AS mx FROM v WHERE value IS NOT NULL GROUP BY "column"),
c AS (SELECT v."column",
             CAST(CASE WHEN r.mx = r.mn THEN 0
                       ELSE least(floor((v.value - r.mn) * {bins} / (r.mx - r.mn)), {bins - 1}) END
                  AS INTEGER) AS bin, count(*) AS n
      FROM v JOIN r ON v."column" = r."column" WHERE v.value IS NOT NULL GROUP BY ALL),
g AS (SELECT "column", mn, mx, unnest(range(0, {bins})) AS bin FROM r)
SELECT g."column", CAST(g.bin AS INTEGER) AS bin,
       round(mn + g.bin * ((mx - mn) / {bins}), 6) AS lo,
       round(mn + (g.bin + 1) * ((mx - mn) / {bins}), 6) AS hi,
       coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON g."column" = c."column" AND g.bin = c.bin"""


HIST30_COLS = ["l_extendedprice", "l_discount", "l_quantity"]


@query("hist_30", "WITH " + _hist_sql("lineitem", HIST30_COLS, 30).strip(), ops="A1")
def hist_30(spark, sf_dir):
    return profile.histograms(read_table(spark, sf_dir, "lineitem"), HIST30_COLS, 30)


@query("hist_11", with_views(_hist_sql("churn", ["n_prio"], 11), CHURN_SQL), ops="A1")
def hist_11(spark, sf_dir):
    return profile.histograms(churn_view(spark, sf_dir), ["n_prio"], 11)


@query("kde_grid", """
WITH x AS (SELECT CAST(c_acctbal AS DOUBLE) AS x FROM customer WHERE c_acctbal IS NOT NULL),
s AS (SELECT min(x) AS mn, max(x) AS mx, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM x),
g AS (SELECT unnest(range(0, 200)) AS i)
SELECT CAST(i AS INTEGER) AS i, round(mn + (mx - mn) * i / 199, 6) AS x,
       round(sum(exp(-0.5 * pow((mn + (mx - mn) * i / 199 - x.x) / h, 2))) / (n * h * sqrt(2 * pi())), 6)
         AS density
FROM x, s, g GROUP BY i, mn, mx, n, h""", ops="A2")
def kde_grid(spark, sf_dir):
    return profile.kde_grid(read_table(spark, sf_dir, "customer"), "c_acctbal", 200)


@query("qcut_bins", with_views(f"""
e AS (SELECT list_sort(list_distinct(quantile_cont(spend, {DECILES}))) AS edges
      FROM churn WHERE spend IS NOT NULL)
SELECT c.c_custkey,
       CAST(CASE WHEN c.spend IS NULL THEN NULL
                 ELSE len(list_filter(e.edges[2:len(e.edges) - 1], lambda x: x < c.spend)) END
            AS INTEGER) AS bin
FROM churn c, e""", CHURN_SQL), ops="A3")
def qcut_bins(spark, sf_dir):
    ch = churn_view(spark, sf_dir).select("c_custkey", "spend")
    return profile.qcut(ch, "spend", 10).select("c_custkey", "bin")


@query("class_by_decile_acctbal",
       with_views(_qcut_sql("churn", "c_acctbal", "exited"), CHURN_SQL), ops="A3 A4")
def class_by_decile_acctbal(spark, sf_dir):
    return profile.class_distribution(churn_view(spark, sf_dir), "c_acctbal", "exited", 10)


@query("category_counts", with_views("""
u AS (UNPIVOT (SELECT r_name, c_mktsegment, CAST(exited AS VARCHAR) AS exited FROM churn)
      ON r_name, c_mktsegment, exited INTO NAME "column" VALUE value)
SELECT "column", value, count(*) AS n FROM u GROUP BY "column", value""", CHURN_SQL), ops="A5")
def category_counts(spark, sf_dir):
    return profile.category_counts(churn_view(spark, sf_dir), ["r_name", "c_mktsegment", "exited"])


@query("label_share", with_views("""
SELECT exited, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM churn GROUP BY exited""", CHURN_SQL), ops="A6")
def label_share(spark, sf_dir):
    return profile.label_share(churn_view(spark, sf_dir), "exited")


CORR_COLS = ["c_acctbal", "n_orders", "spend", "n_prio", "exited"]


def _corr_sql(cols: list[str], where: str) -> str:
    parts = []
    for i, a in enumerate(cols):
        parts.append(f"SELECT '{a}' AS a, '{a}' AS b, 1.0::DOUBLE AS corr")
        for b in cols[i + 1:]:
            for x, y in ((a, b), (b, a)):
                parts.append(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({a}, {b}), 6) AS corr "
                             f"FROM churn {where}")
    return with_views(" UNION ALL ".join(parts), CHURN_SQL)


@query("corr_matrix", _corr_sql(CORR_COLS, ""), ops="A10")
def corr_matrix(spark, sf_dir):
    return profile.corr_matrix(churn_view(spark, sf_dir), CORR_COLS)


@query("corr_matrix_class", _corr_sql(CORR_COLS[:-1], "WHERE exited = 1"), ops="A11 P5")
def corr_matrix_class(spark, sf_dir):
    from attrition.operators.clean import class_filter
    return profile.corr_matrix(class_filter(churn_view(spark, sf_dir), "exited", 1), CORR_COLS[:-1])


@query("box_stats", with_views("""
q AS (SELECT c_mktsegment AS g, quantile_cont(spend, 0.25) AS q1, quantile_cont(spend, 0.5) AS median,
             quantile_cont(spend, 0.75) AS q3 FROM churn WHERE spend IS NOT NULL GROUP BY 1),
j AS (SELECT c.c_mktsegment, c.spend, q.q1, q.median, q.q3,
             c.spend >= q.q1 - 1.5 * (q.q3 - q.q1) AND c.spend <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
      FROM churn c JOIN q ON c.c_mktsegment = q.g WHERE c.spend IS NOT NULL)
SELECT c_mktsegment, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(spend) FILTER (WHERE inside), 6) AS whisker_lo,
       round(max(spend) FILTER (WHERE inside), 6) AS whisker_hi,
       count(*) FILTER (WHERE NOT inside) AS n_outliers, count(*) AS n
FROM j GROUP BY c_mktsegment, q1, median, q3""", CHURN_SQL), ops="A12")
def box_stats(spark, sf_dir):
    return profile.box_stats(churn_view(spark, sf_dir), "c_mktsegment", "spend")


@query("group_mean_ci", with_views("""
SELECT r_name, round(avg(spend), 6) AS mean, count(spend) AS n,
       round(avg(spend) - 1.96 * stddev_samp(spend) / sqrt(count(spend)), 6) AS ci_lo,
       round(avg(spend) + 1.96 * stddev_samp(spend) / sqrt(count(spend)), 6) AS ci_hi
FROM churn GROUP BY r_name""", CHURN_SQL), ops="A13")
def group_mean_ci(spark, sf_dir):
    return profile.group_mean_ci(churn_view(spark, sf_dir), "r_name", "spend")


PAIR_COLS = ["c_acctbal", "spend", "n_orders"]


def _pair_sql() -> str:
    rng = ", ".join(f"min(CAST({c} AS DOUBLE)) AS mn_{c}, max(CAST({c} AS DOUBLE)) AS mx_{c}"
                    for c in PAIR_COLS)

    def b(c):
        return f"CAST(least(floor((CAST({c} AS DOUBLE) - mn_{c}) * 10 / (mx_{c} - mn_{c})), 9) AS INTEGER)"
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in PAIR_COLS)
    parts = []
    for i, a in enumerate(PAIR_COLS):
        for c in PAIR_COLS[i + 1:]:
            parts.append(f"SELECT exited, '{a}' AS x_col, '{c}' AS y_col, {b(a)} AS x_bin, "
                         f"{b(c)} AS y_bin FROM churn, r WHERE {notnull}")
    return with_views(f"""
r AS (SELECT {rng} FROM churn),
p AS ({" UNION ALL ".join(parts)})
SELECT exited, x_col, y_col, x_bin, y_bin, count(*) AS n FROM p GROUP BY ALL""", CHURN_SQL)


@query("pair_bins", _pair_sql(), ops="A14")
def pair_bins(spark, sf_dir):
    return profile.pair_bins(churn_view(spark, sf_dir), PAIR_COLS, 10, hue="exited")


@query("scatter3_counts", """
SELECT l_quantity, l_discount, l_tax, l_returnflag, count(*) AS n FROM lineitem
GROUP BY l_quantity, l_discount, l_tax, l_returnflag""", ops="A15")
def scatter3_counts(spark, sf_dir):
    return profile.scatter3_counts(read_table(spark, sf_dir, "lineitem"),
                                   ["l_quantity", "l_discount", "l_tax"], "l_returnflag")
