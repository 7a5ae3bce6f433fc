"""Property tests on random small tables (hypothesis), per the survey's invariants."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fraudscope.functions.bands import with_bands
from fraudscope.operators import quality as dq
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th
from fraudscope.schema import TXN_SCHEMA

TYPES = st.sampled_from(["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER", None])
AMOUNTS = st.one_of(
    st.none(),
    st.sampled_from([0.0, -12.5, 1000.0, 10000.0, 200000.0, 100000.0]),
    st.integers(min_value=-100_00, max_value=900_000_00).map(lambda c: c / 100),
)
LABELS = st.sampled_from([0, 1, None])
ROW = st.tuples(
    st.integers(min_value=1, max_value=48),
    TYPES,
    AMOUNTS,
    st.sampled_from(["C1", "C2"]),
    st.sampled_from([0.0, 500.0, 5000.0, 50000.0, 500000.0]),
    st.sampled_from([0.0, 10.0, None]),
    st.sampled_from(["M1", "C3", None]),
    st.sampled_from([0.0, 7.0, None]),
    st.sampled_from([0.0, 7.0, None]),
    LABELS,
    st.sampled_from([0, 1]),
)
TABLES = st.lists(ROW, min_size=0, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _key(row):
    return [(v is None, str(v)) for v in row]


@SETTINGS
@given(rows=TABLES)
def test_bands_partition_the_table(spark, rows):
    df = with_bands(spark.createDataFrame(rows, TXN_SCHEMA))
    total = len(rows)
    for fn in (seg.by_amount_band, seg.by_origin_balance_band, seg.by_type):
        assert sum(r.total_transactions for r in fn(df).collect()) == total


@SETTINGS
@given(rows=TABLES)
def test_rules_nest_and_split(spark, rows):
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    a, b = th.compare(df, (th.RULE_A, th.RULE_B)).collect()
    assert b.flagged_transactions <= a.flagged_transactions
    for r in (a, b):
        captured = r.fraud_captured_count or 0
        affected = r.legit_affected_count or 0
        assert captured + affected <= r.flagged_transactions
    labelled = [x for x in rows if x[9] is not None]
    if len(labelled) == len(rows):
        assert (a.fraud_captured_count or 0) + (a.legit_affected_count or 0) == a.flagged_transactions


@SETTINGS
@given(rows=TABLES)
def test_one_pass_equals_union_form(spark, rows):
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    rules = th.DASHBOARD_RULES + (th.Rule("debit > 0", 0.0, ("DEBIT",)),)
    a = sorted(map(tuple, th.compare(df, rules).collect()), key=_key)
    b = sorted(map(tuple, th.compare_union(df, rules).collect()), key=_key)
    assert a == b


@SETTINGS
@given(rows=TABLES)
def test_duplicates_add_up(spark, rows):
    df = spark.createDataFrame(rows + rows[:3], TXN_SCHEMA)
    r = dq.duplicate_summary(df).first()
    assert r.total_rows == len(rows) + min(3, len(rows))
    assert r.total_rows == r.distinct_rows + r.duplicate_rows
    assert r.distinct_rows == len(set(rows + rows[:3]))


@SETTINGS
@given(rows=TABLES, period_hours=st.sampled_from([6, 24]))
def test_monitoring_tables_add_up(spark, rows, period_hours):
    from fraudscope.operators import monitoring as mon

    df = spark.createDataFrame(rows, TXN_SCHEMA)
    metrics = mon.weekly_metrics(df, period_hours).collect()
    assert sum(r.total_transactions for r in metrics) == len(rows)
    assert sum(r.fraud_count for r in metrics) == sum(1 for x in rows if x[9] == 1)
    periods = [r.period for r in metrics]
    assert periods == list(range(periods[0], periods[-1] + 1)) if periods else True  # no gaps
    by_type = mon.weekly_rate_by_type(df, period_hours).collect()
    per_period = {}
    for r in by_type:
        per_period[r.period] = per_period.get(r.period, 0) + r.total_transactions
    assert per_period == {r.period: r.total_transactions for r in metrics}
    for r in mon.weekly_threshold(df, period_hours).collect():
        assert r.fraud_captured_count + r.legit_affected_count <= r.above_threshold_count <= r.total_transactions


RULES = st.lists(
    st.tuples(st.integers(min_value=-1, max_value=300).map(lambda k: k * 1000.0), st.sampled_from([None, ("TRANSFER",), ("CASH_OUT", "DEBIT")])),
    min_size=11,
    max_size=14,
)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=TABLES, specs=RULES)
def test_narrow_rule_sweep_equals_union_form(spark, rows, specs):
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    rules = [th.Rule(f"r{i}", amt, types) for i, (amt, types) in enumerate(specs)]
    a = sorted(map(tuple, th.compare(df, rules).collect()), key=_key)
    b = sorted(map(tuple, th.compare_union(df, rules).collect()), key=_key)
    assert a == b
