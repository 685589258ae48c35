"""Every SQL-checkable query against its DuckDB oracle on the smallest
scale factor; rows-only queries must run and return rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

from attrition.plans import load_all
from attrition.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_matches_oracle(spark, con, name):
    q = REG[name]
    df = q.build(spark, SF)
    rows = df.collect()
    res = con.execute(q.sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, rows) == _bag(dcols, drows)


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if not q.sql))
def test_rows_only_runs(spark, name):
    rows = REG[name].build(spark, SF).collect()
    assert len(rows) > 0


@pytest.mark.parametrize("name", ["fit_linear_svc", "fit_rff_svc", "fit_poly_svc"])
def test_svms_learn_the_learnable_view(spark, name):
    row = REG[name].build(spark, "/root/testdata/sf0.01").first()
    assert row["roc_auc"] >= 0.95 and row["tn"] > 0 and row["tp"] > 0
