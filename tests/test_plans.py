"""Plan properties: no Python UDF nodes, filters pushed to the scan."""
import pytest

import __spark_entry__ as entry
from conftest import SMOKE

CHECK = ["early_warning", "risk_state", "group_risk", "member_decision", "collection_date"]


@pytest.mark.parametrize("name", CHECK)
def test_no_python_udf(spark, name):
    plan = entry.queries()[name](spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_lineitem_filter_pushed(spark):
    from memberrisk.sources import fixtures as FX
    plan = FX.movements(FX.Tables(spark, SMOKE))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThan(l_shipdate" in plan


def test_latest_period_prunes_partitions(spark):
    from memberrisk.plans.pipeline import hub
    plan = hub(spark, SMOKE).last_period().select("v_ah_cliente")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(periodo" in plan and "ReadSchema: struct<v_ah_cliente:bigint>" in plan
