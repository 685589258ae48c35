"""Plan-shape guards: no cross joins in any registered query, filters and
projections reach the parquet scan."""

import pytest

from attrition.plans import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_no_cross_join(spark, name):
    plan = _plan(REG[name].build(spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_and_projection_pushed_to_scan(spark):
    plan = _plan(REG["class_filter"].build(spark, SF))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double" in scan
    assert "l_tax" not in scan and "l_shipdate" not in scan
