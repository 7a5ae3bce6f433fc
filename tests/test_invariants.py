"""Invariants from the reference's own arithmetic, on the sf0.01 fixture."""

from __future__ import annotations

from fraudscope.functions.bands import with_bands
from fraudscope.operators import monitoring as mon
from fraudscope.operators import quality as dq
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th


def test_band_totals_equal_overall(txn01):
    total = seg.kpi_overall(txn01).first()
    banded = with_bands(txn01)
    for fn in (seg.by_amount_band, seg.by_origin_balance_band, seg.by_type):
        rows = fn(banded).collect()
        assert sum(r.total_transactions for r in rows) == total.total_transactions
        assert sum(r.fraud_count or 0 for r in rows) == total.fraud_count


def test_rule_b_within_rule_a(txn01):
    a, b = th.compare(txn01, (th.RULE_A, th.RULE_B)).collect()
    for col in ("flagged_transactions", "fraud_captured_count", "legit_affected_count"):
        assert b[col] <= a[col]


def test_fixture_rule_counts(txn01):
    got = {r.threshold_name: (r.flagged_transactions, r.fraud_captured_count) for r in th.compare(txn01).collect()}
    assert sorted(got.values()) == [(1218, 44), (1471, 53), (3664, 53)]


def test_captured_plus_affected_within_flagged(txn01):
    for r in th.compare(txn01).collect():
        assert r.fraud_captured_count + r.legit_affected_count <= r.flagged_transactions


def test_queue_volumes(txn01):
    got = {r.review_queue: r["count"] for r in th.review_queue(txn01).groupBy("review_queue").count().collect()}
    assert got == {"primary": 1471, "watchlist": 488, "none": 8061}


def test_duplicates_total(txn01):
    r = dq.duplicate_summary(txn01).first()
    assert r.total_rows == r.distinct_rows + r.duplicate_rows == 10020
    assert dq.duplicate_groups(txn01).count() == 20


def test_fixture_quality_counts(txn01):
    r = dq.report(txn01).first()
    assert r.inconsistent_origin_balance == 3336
    assert r.inconsistent_dest_balance == 2033
    assert r.neg_newbalanceOrig == 5401
    assert dq.amount_outliers(txn01).count() == 183


def test_segment_counts(txn01):
    banded = with_bands(txn01)
    assert seg.combined(banded, ["type", "amount_band"]).count() == 20
    assert seg.combined(banded, ["type", "origin_balance_band"]).count() == 25
    assert seg.combined(banded, ["type", "amount_band", "origin_balance_band"]).count() == 35
    assert seg.top_risk(banded).count() == 12


def test_daily_periods_and_alerts(txn01):
    daily = mon.weekly_metrics(txn01, 24)
    assert daily.count() == 30
    assert mon.fraud_rate_spike(daily).where("alert").count() == 8


def test_weekly_spine_has_no_gap(spark, txn01):
    sparse = txn01.where("step <= 168 OR step > 504")  # weeks 1 and 2 empty
    rows = mon.weekly_metrics(sparse).collect()
    assert [r.period for r in rows] == [0, 1, 2, 3, 4]
    assert rows[1].total_transactions == 0 and rows[1].fraud_rate_pct is None
    by_type = mon.weekly_rate_by_type(sparse)
    assert by_type.count() == 5 * 6  # every (period, type) incl. NULL type


def test_compare_output_contract(txn01):
    assert th.compare(txn01).columns == th.COMPARE_COLUMNS
    assert th.compare_union(txn01).columns == th.COMPARE_COLUMNS
