"""Duplicates across landings; quality checks on tables with other column names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fraudscope.operators import quality as dq
from fraudscope.operators.ledger import RowLedger
from fraudscope.schema import BALANCE_COLUMNS, TXN_COLUMNS, TXN_SCHEMA
from fraudscope.session import scratch_path


def _rows(df):
    return [tuple(r) for r in df.collect()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_across_landings_equal_the_full_run(spark, txn01):
    nan, nothing = float("nan"), None
    odd = [(1, "DEBIT", nan, "C1", 0.0, 0.0, "C2", 0.0, nothing, nothing, 0), (1, "DEBIT", 0.0, "C1", -0.0, 0.0, "", 0.0, 0.0, 0, 0), (1, "DEBIT", 0.0, "C1", 0.0, 0.0, nothing, 0.0, 0.0, 0, 0)]
    odd = spark.createDataFrame(odd, TXN_SCHEMA)
    minus = odd.withColumn("oldbalanceOrg", -F.col("oldbalanceOrg"))
    parts = [txn01.where("step <= 400").unionByName(odd), txn01.where("step > 300").unionByName(minus), txn01.where("amount > 150000"), txn01.limit(0)]
    path = scratch_path(spark, "test-ledger")
    ledger = RowLedger(spark, f"ledger_{path[-32:]}", path, buckets=4)
    assert ledger.summary().first().total_rows == 0 and ledger.groups().count() == 0
    whole = None
    for i, part in enumerate(parts):
        ledger.add(part, f"l{i}")
        whole = part if whole is None else whole.unionByName(part)
        assert _rows(ledger.summary()) == _rows(dq.duplicate_summary(whole))
    got, want = ledger.groups(), dq.duplicate_groups(whole)
    assert got.columns == want.columns
    assert sorted(map(str, _rows(got))) == sorted(map(str, _rows(want)))
    n_new = ledger.repeats_of("l1").count()
    assert n_new == txn01.where("step > 300 and (step <= 400 or amount > 150000)").distinct().count() + 3

    # the ledger lies by bucket: neither the totals nor the join with a landing deal it out again
    assert "Exchange hashpartitioning(digest" not in _plan(ledger.repeats_of("l2"))
    assert _plan(ledger.summary()).count("Exchange") == 1  # the one-row sum

    with pytest.raises(ValueError, match="already"):
        ledger.add(parts[0], "l0")
    with pytest.raises(ValueError, match="4 buckets"):
        RowLedger(spark, f"other_{path[-32:]}", path, buckets=8)
    again = RowLedger(spark, f"again_{path[-32:]}", path, buckets=4)  # as another session attaches
    assert again.landings() == ["l0", "l1", "l2"]  # an empty landing leaves nothing
    assert _rows(again.summary()) == _rows(ledger.summary())


def test_a_failed_landing_can_be_repeated(spark, txn01):
    path = scratch_path(spark, "test-ledger")
    ledger = RowLedger(spark, f"ledger_{path[-32:]}", path, buckets=4)
    few = txn01.where("step <= 20")
    broken = few.withColumn("type", F.when(F.col("step") > 10, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("type")))
    with pytest.raises(Exception, match="lost"):
        ledger.add(broken, "a")
    assert ledger.landings() == []
    ledger.add(few, "a")
    assert _rows(ledger.summary()) == _rows(dq.duplicate_summary(few))


NAMES = {c: f"t_{c}" for c in TXN_COLUMNS}


def _renamed(df):
    return df.withColumnsRenamed(NAMES).withColumn("more", F.lit(1))


@pytest.mark.parametrize(
    "check, args",
    [
        (dq.merchant_missing, {"name": "nameDest"}),
        (dq.invalid_amount_counts, {"amount": "amount"}),
        (dq.invalid_amount_rows, {"amount": "amount"}),
        (dq.amount_stats, {"amount": "amount"}),
        (dq.top_amounts, {"amount": "amount"}),
        (dq.origin_mismatch_count, {"amount": "amount", "before": "oldbalanceOrg", "after": "newbalanceOrig"}),
        (dq.origin_mismatch_rows, {"amount": "amount", "before": "oldbalanceOrg", "after": "newbalanceOrig"}),
        (dq.dest_mismatch_count, {"amount": "amount", "before": "oldbalanceDest", "after": "newbalanceDest", "name": "nameDest"}),
        (dq.dest_mismatch_rows, {"amount": "amount", "before": "oldbalanceDest", "after": "newbalanceDest", "name": "nameDest"}),
        (dq.fraud_distribution, {"label": "isFraud"}),
        (dq.type_by_label, {"type_col": "type", "label": "isFraud"}),
        (dq.amount_outliers, {"amount": "amount"}),
        (dq.outlier_cutoff, {"amount": "amount"}),
        (dq.flagged_rows, {"flag": "isFlaggedFraud"}),
        (dq.flagged_stats, {"flag": "isFlaggedFraud", "amount": "amount"}),
        (dq.flagged_by_type, {"flag": "isFlaggedFraud", "type_col": "type"}),
        (dq.unflagged_large_transfers, {"amount": "amount", "type_col": "type", "flag": "isFlaggedFraud"}),
        (dq.unflagged_fraud_transfers, {"amount": "amount", "type_col": "type", "flag": "isFlaggedFraud", "label": "isFraud"}),
        (dq.zero_origin_balance, {"amount": "amount", "before": "oldbalanceOrg"}),
        (dq.zero_dest_balance, {"amount": "amount", "before": "oldbalanceDest", "name": "nameDest"}),
    ],
)
def test_checks_take_column_names(txn01, check, args):
    names = {k: NAMES[v] for k, v in args.items()}
    if check is dq.merchant_missing:
        names["balances"] = [NAMES["oldbalanceDest"], NAMES["newbalanceDest"]]
    got, want = check(_renamed(txn01), **names), check(txn01)
    rows = [tuple(v for c, v in zip(got.columns, r) if c != "more") for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, _rows(want))) and rows


def test_balance_checks_on_some_rows(txn01):
    some = (F.col("type") == "TRANSFER") & (F.col("step") <= 100)
    assert _rows(dq.origin_mismatch_count(txn01, where=some)) == _rows(dq.origin_mismatch_count(txn01.where(some)))
    assert _rows(dq.origin_mismatch_rows(txn01, where="type = 'TRANSFER'")) == _rows(dq.origin_mismatch_rows(txn01.where("type = 'TRANSFER'")))
    assert _rows(dq.dest_mismatch_count(txn01, where=some)) == _rows(dq.dest_mismatch_count(txn01.where(some)))
    assert 0 < dq.dest_mismatch_rows(txn01, 7, where=some).count() <= 7
    assert _rows(dq.negative_balances(_renamed(txn01), [NAMES[c] for c in BALANCE_COLUMNS])) == _rows(dq.negative_balances(txn01))
