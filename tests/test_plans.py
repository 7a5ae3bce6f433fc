"""Plan shapes behind the scale claims, checked on the landed Parquet table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fraudscope.operators import monitoring as mon
from fraudscope.operators import quality as dq
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th

JOINS = ("BroadcastNestedLoopJoin", "CartesianProduct", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def _scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet|Scan parquet", plan))


def test_compare_is_one_scan_one_exchange_no_join(landed01):
    sweep = [th.Rule(f"r{k}", k * 1000.0) for k in range(30)]  # no type filter: `type` is pruned
    for rules, schema in (
        (th.DASHBOARD_RULES, "struct<type:string,amount:double,isFraud:bigint>"),
        (sweep, "struct<amount:double,isFraud:bigint>"),
    ):
        plan = _plan(th.compare(landed01, rules))
        assert _scans(plan) == 1
        assert not any(j in plan for j in JOINS)
        assert f"ReadSchema: {schema}" in _formatted(th.compare(landed01, rules))


def test_fused_report_and_summary_are_single_scans(landed01):
    for df in (dq.report(landed01), seg.executive_summary(landed01), seg.kpi_by_type(landed01)):
        plan = _plan(df)
        assert _scans(plan) == 1
        assert not any(j in plan for j in JOINS)


def test_row_filters_reach_the_scan(landed01):
    text = _formatted(dq.unflagged_fraud_transfers(landed01))
    assert "GreaterThan(amount,200000.0)" in text and "EqualTo(type,TRANSFER)" in text


def test_outlier_cutoff_is_a_scalar_subquery(landed01):
    df = dq.amount_outliers(landed01)
    plan = _plan(df)
    assert "Subquery" in plan and not any(j in plan for j in JOINS)


def test_monitoring_scans_base_table_once(landed01):
    # the aggregate is checkpointed: the remaining plan reads checkpointed rows only
    plan = _plan(mon.weekly_rate_by_type(landed01))
    assert _scans(plan) == 0
    assert "ExistingRDD" in plan


def test_global_sort_splits_a_hot_group_of_copies(spark):
    from fraudscope.schema import TXN_SCHEMA

    row = (1, "CASH_IN", -1.0, "C1", 0.0, 0.0, "C2", 0.0, 0.0, 0, 0)
    df = spark.createDataFrame([row] * 4000 + [(2,) + row[1:]] * 10, TXN_SCHEMA).repartition(4)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = dq.invalid_amount_rows(df).rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == 4010
    assert max(sizes) < 4000  # the 4000 identical rows did not all land in one task
    rows = dq.invalid_amount_rows(df).select("step").collect()
    assert [r.step for r in rows][-10:] == [2] * 10 and rows[0].step == 1
