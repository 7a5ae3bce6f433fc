"""Parameters and guards: money scale, rows without a step, review rules, rollups of other rules, spine bound."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fraudscope.functions.exprs import money_scale
from fraudscope.functions.measures import PARTIALS, rollup
from fraudscope.operators import monitoring as mon
from fraudscope.operators import quality as dq
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th
from fraudscope.schema import TXN_SCHEMA
from fraudscope.session import scratch_path
from fraudscope.sinks import export
from fraudscope.sources import preview, stream_transactions
from fraudscope.streaming import jobs as st


def _txn(spark, steps, amounts):
    rows = [(s, "TRANSFER", a, "C1", 10.0, 9.0, "C2", 0.0, 1.0, i % 2, 0) for i, (s, a) in enumerate(zip(steps, amounts))]
    return spark.createDataFrame(rows, TXN_SCHEMA)


def test_money_scale(spark):
    df = _txn(spark, [1] * 1000, [0.004] * 1000)
    assert seg.kpi_overall(df).first().total_value == 0.0
    with pytest.raises(ValueError, match="finer_amount"):
        dq.require_exact_money(df)
    with money_scale(3):
        dq.require_exact_money(df)
        totals = [seg.kpi_overall(df), th.base_totals(df), mon.weekly_metrics(df)]
        assert [t.first().total_value for t in totals] == [4.0] * 3
        assert th.compare(rollup(df, ["type"], th.DASHBOARD_RULES), m=PARTIALS).count() == 3
    assert seg.kpi_overall(df).first().total_value == 0.0
    with pytest.raises(ValueError):
        with money_scale(13):
            pass


def test_amounts_that_no_sum_holds_are_counted(spark):
    df = _txn(spark, [1] * 5, [float("nan"), float("inf"), 1.005, 1.25, None])
    r = dq.report(df).first()
    assert (r.not_finite_amount, r.finer_amount) == (2, 1)
    with pytest.raises(ValueError, match="not_finite_amount"):
        dq.require_exact_money(df)


def test_rows_without_step_add_up(spark):
    df = _txn(spark, [None, None, -5, 0, 1, 200], [1.0] * 6)
    m = mon.weekly_metrics(df).collect()
    assert {r.period: r.total_transactions for r in m} == {None: 2, -1: 2, 0: 1, 1: 1}
    assert sum(r.total_value for r in m) == seg.kpi_overall(df).first().total_value
    by_type = mon.weekly_rate_by_type(df)
    assert by_type.agg(F.sum("total_transactions")).first()[0] == 6
    alerts = [mon.fraud_rate_spike(mon.weekly_metrics(df)), mon.week_over_week(by_type, "TRANSFER"), mon.value_concentration(df)]
    assert all(a.where("period IS NULL").isEmpty() for a in alerts)
    assert mon.weekly_metrics(df.limit(0)).isEmpty()


def test_corrupt_step_raises(spark):
    df = _txn(spark, [1, 10**15], [1.0, 1.0])
    with pytest.raises(Exception, match="is a step corrupt"):
        mon.weekly_metrics(df).collect()


def test_review_rule_is_an_argument(spark, txn01):
    rule = th.Rule("small", 1000.0, ("PAYMENT",))
    got = mon.weekly_threshold(txn01, rule=rule).agg(F.sum("review_queue_volume"), F.sum("watchlist_volume")).first()
    watched = txn01.where("type = 'TRANSFER' AND amount > 100000").count()
    assert tuple(got) == (txn01.where("type = 'PAYMENT' AND amount > 1000").count(), watched)


def test_rollup_of_other_rules_raises(spark, txn01):
    r = rollup(txn01, ["type"], mon.MONITOR_RULES)
    path = scratch_path(spark, "rollup")
    r.write.parquet(path)
    for partials in (r, mon.materialize(r), spark.read.parquet(path)):
        with pytest.raises(ValueError, match="rule 0"):
            th.compare(partials, (th.RULE_A, th.RULE_C), PARTIALS)
        assert th.compare(partials, mon.MONITOR_RULES, PARTIALS).count() == 2
    with pytest.raises(ValueError, match="rule 2 is absent"):
        th.compare(r, (*mon.MONITOR_RULES, th.RULE_A), PARTIALS)
    with pytest.raises(ValueError, match="rule 0"):
        mon.threshold_from_rollup(rollup(mon.with_period(txn01), ["period"], th.DASHBOARD_RULES))


def test_stream_reports_rows_without_step(spark):
    base = scratch_path(spark, "st-null")
    _txn(spark, [None, 1, 500], [1.0] * 3).write.parquet(f"{base}/in")
    q = st.start_window_partials(stream_transactions(spark, f"{base}/in"), f"{base}/out", f"{base}/_c", available_now=True)
    with pytest.raises(st.RowsWithoutStep, match="^1 rows"):
        st.run_to_end(q)


def test_unordered_samples_stop_early(spark, landed01):
    for sample in (preview, dq.origin_mismatch_rows, dq.dest_mismatch_rows, dq.zero_dest_balance):
        df = sample(landed01, 3, ordered=False)
        assert df.count() == 3
        assert "TakeOrdered" not in df._jdf.queryExecution().executedPlan().toString()


def test_export_keeps_small_doubles(spark):
    path = scratch_path(spark, "doubles")
    values = [3.0e-12, 1.2345678901234e-8, 0.0002, 24.7191, 0.0, 1e18]
    export(spark.createDataFrame([(v,) for v in values], "rate double"), path)
    got = spark.read.option("header", True).schema("rate double").csv(path, sep="\t")
    assert sorted(r.rate for r in got.collect()) == sorted(values)
    assert "0.0002" in [r[0] for r in spark.read.option("header", True).csv(path).collect()]
