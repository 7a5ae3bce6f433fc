"""Hand-made edge rows: band cut-offs, NULL routing, empty inputs, ties."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fraudscope.functions.bands import AMOUNT_BAND, BALANCE_BAND, with_bands
from fraudscope.operators import quality as dq
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th
from fraudscope.schema import TXN_SCHEMA


def _rows(spark, rows):
    full = []
    for r in rows:
        base = dict(step=1, type="TRANSFER", amount=1.0, nameOrig="C1", oldbalanceOrg=10.0, newbalanceOrig=9.0,
                    nameDest="C2", oldbalanceDest=0.0, newbalanceDest=1.0, isFraud=0, isFlaggedFraud=0)
        base.update(r)
        full.append(tuple(base[f.name] for f in TXN_SCHEMA.fields))
    return spark.createDataFrame(full, TXN_SCHEMA)


def test_amount_band_cuts(spark):
    vals = [None, -5.0, 0.0, 1000.0, 1000.01, 10000.0, 50000.0, 100000.0, 200000.0, 200000.01]
    df = _rows(spark, [{"amount": v} for v in vals])
    got = [r[0] for r in df.select(AMOUNT_BAND.label()).collect()]
    assert got == ["200K+", "0-1K", "0-1K", "0-1K", "1K-10K", "1K-10K", "10K-50K", "50K-100K", "100K-200K", "200K+"]


def test_balance_band_cuts(spark):
    vals = [None, -1.0, 0.0, 0.5, 1000.0, 1000.5, 100000.0, 100000.01]
    df = _rows(spark, [{"oldbalanceOrg": v} for v in vals])
    got = [tuple(r) for r in with_bands(df).select("origin_balance_band", "origin_balance_zero_flag").collect()]
    assert got == [("100K+", 0), ("1-1K", 0), ("0", 1), ("1-1K", 0), ("1-1K", 0), ("1K-10K", 0), ("10K-100K", 0), ("100K+", 0)]


def test_band_rank_matches_label_order(spark):
    df = spark.createDataFrame([(lab,) for lab in AMOUNT_BAND.ordered_labels], ["amount_band"])
    ranks = [r[0] for r in df.select(AMOUNT_BAND.rank()).collect()]
    assert ranks == list(range(1, len(AMOUNT_BAND.ordered_labels) + 1))
    assert BALANCE_BAND.ordered_labels[0] == "0"


def test_rule_that_flags_nothing_keeps_its_row(spark):
    df = _rows(spark, [{"amount": 10.0}, {"amount": None, "isFraud": 1}])
    out = th.compare(df, (th.Rule("none", 1e12), th.Rule("all", 0.0))).collect()
    by = {r.threshold_name: r for r in out}
    assert by["none"].flagged_transactions == 0
    assert by["none"].flagged_value is None and by["none"].fraud_captured_count is None
    assert by["all"].flagged_transactions == 1  # NULL amount is never flagged
    assert by["all"].fraud_captured_count == 0


def test_one_pass_equals_union(txn01):
    rules = th.DASHBOARD_RULES + (th.Rule("empty", 1e15, ("DEBIT",)),)
    a = sorted(tuple(r) for r in th.compare(txn01, rules).collect())
    b = sorted(tuple(r) for r in th.compare_union(txn01, rules).collect())
    assert a == b


def test_null_label_in_neither_bucket(spark):
    df = _rows(spark, [{"isFraud": None, "amount": 300000.0}, {"isFraud": 1, "amount": 300000.0}])
    r = th.base_totals(df).first()
    assert r.total_transactions == 2 and r.total_fraud_count == 1 and r.total_legit_count == 0


def test_not_like_on_null_drops_row(spark):
    df = _rows(spark, [{"nameDest": None, "oldbalanceDest": 0.0, "newbalanceDest": 5.0}])
    assert dq.dest_mismatch_count(df).first()[0] == 0


def test_executive_summary_empty_input_gives_no_row(spark):
    df = _rows(spark, []).where("false")
    assert seg.executive_summary(df).count() == 0


def test_executive_summary_ties_are_deterministic(spark):
    df = _rows(spark, [{"type": "B", "isFraud": 0}, {"type": "A", "isFraud": 0}, {"type": None, "isFraud": None}])
    assert seg.executive_summary(df).first().top_risk_transaction_type == "A"


def test_sum_label_vs_conditional_count(spark):
    df = _rows(spark, [{"type": "X", "isFraud": None}])
    kpi = seg.kpi_by_type(df).first()
    assert kpi.fraud_count is None  # SUM(isFraud) over all-NULL labels
    assert seg.trend_by_step(df).first().fraud_count == 0  # conditional count


def test_share_uses_surviving_segments_only(spark):
    rows = [{"type": "A", "amount": 5.0, "isFraud": 1}] * 100 + [{"type": "B", "amount": 5.0, "isFraud": 1}] * 3
    out = seg.fraud_share(with_bands(_rows(spark, rows))).collect()
    assert len(out) == 1 and out[0].share_of_total_fraud_pct == 100.0


def test_duplicate_summary_nulls_equal(spark):
    df = _rows(spark, [{"type": None}, {"type": None}, {"type": "A"}])
    r = dq.duplicate_summary(df).first()
    assert (r.total_rows, r.distinct_rows, r.duplicate_rows) == (3, 2, 1)


def test_outliers_one_row_keeps_nothing(spark):
    assert dq.amount_outliers(_rows(spark, [{}])).count() == 0


@pytest.mark.parametrize("n", [1, 7])
def test_results_stable_under_repartition(txn01, n):
    shuffled = txn01.repartition(n).orderBy(F.rand(3))
    def key(row):
        return [(v is None, str(v)) for v in row]

    for fn in (seg.kpi_by_type, seg.executive_summary, dq.report, lambda d: th.compare(d)):
        a = sorted(map(tuple, fn(txn01).collect()), key=key)
        b = sorted(map(tuple, fn(shuffled).collect()), key=key)
        assert a == b


def test_top_k_with_ties_is_deterministic(spark):
    rows = [{"amount": 5.0, "nameOrig": f"C{i}"} for i in range(30)]
    df = _rows(spark, rows)
    a = [tuple(r) for r in dq.top_amounts(df.repartition(4)).collect()]
    b = [tuple(r) for r in dq.top_amounts(df.repartition(3)).collect()]
    assert a == b and len(a) == 20


def test_many_rules_narrow_path_equals_union(txn01):
    sweep = [th.Rule(f"r{k}", k * 1000, ("TRANSFER", "CASH_OUT")) for k in range(25, 625, 25)]
    sweep.append(th.Rule("nothing", 1e15))
    key = lambda r: [(v is None, str(v)) for v in r]
    a = sorted(map(tuple, th.compare(txn01, sweep).collect()), key=key)
    b = sorted(map(tuple, th.compare_union(txn01, sweep).collect()), key=key)
    c = sorted(map(tuple, th.compare_wide(txn01, sweep).collect()), key=key)
    assert a == b == c


def test_rules_with_exceptions_equal_union(txn01):
    a = th.Rule("a", 50000.0, ("TRANSFER", "DEBIT"))
    b = th.Rule("b", 10000.0, unless=a)
    rules = (a, b, th.Rule("c", 1000.0, ("DEBIT", "CASH_IN"), unless=b), th.WATCHLIST_ONLY, th.Rule("d", 50000.0))
    got = sorted(map(tuple, th.compare(txn01, rules).collect()), key=lambda r: [(v is None, str(v)) for v in r])
    want = sorted(map(tuple, th.compare_union(txn01, rules).collect()), key=lambda r: [(v is None, str(v)) for v in r])
    assert got == want


def test_duplicates_with_forced_hash_collisions(spark):
    """Every row under one hash, or under three, and the copies are still told from the others."""
    rows = [(i % 7, "PAYMENT", None if i % 3 == 0 else float(i % 5)) for i in range(60)] + [(0, None, -0.0), (0, None, 0.0)]
    df = spark.createDataFrame(rows, "step long, type string, amount double")
    want = {}
    for r in rows:
        want[r] = want.get(r, 0) + 1
    for row_hash in (
        lambda *c: F.lit(1).cast("long"),
        lambda *c: F.pmod(F.xxhash64(*c), F.lit(3)),
        F.xxhash64,
    ):
        s = dq.duplicate_summary(df, df.columns, row_hash).first()
        assert (s.total_rows, s.distinct_rows) == (62, len(want))
        got = dq.duplicate_groups(df, df.columns, row_hash).collect()
        assert {tuple(r[:3]): r.duplicate_count for r in got} == {k: n for k, n in want.items() if n > 1}
    assert dq.duplicate_summary(df.limit(0), df.columns).first().total_rows == 0
