"""Exact outlier cut-offs, sweeps of many rules, and CSV landings with rejects."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fraudscope import files
from fraudscope.functions.exprs import money_scale
from fraudscope.functions.measures import PARTIALS, rollup
from fraudscope.operators import quality as dq
from fraudscope.operators import thresholds as th
from fraudscope.schema import TXN_COLUMNS, TXN_SCHEMA
from fraudscope.session import scratch_path
from fraudscope.sources import TooManyRejects, land_csv, read_landing, read_rejects, read_transactions


def test_outlier_rows_do_not_depend_on_partitions(txn01):
    found = []
    for n in (1, 7, 64):
        dealt = txn01.repartition(n, F.xxhash64("nameOrig", "amount", F.lit(n)))
        cutoff = dq.outlier_cutoff(dealt).first()
        rows = dq.amount_outliers(dealt).collect()
        found.append((tuple(cutoff), [tuple(r) for r in rows]))
    assert found[0] == found[1] == found[2] and len(found[0][1]) == 183


def test_cutoff_from_partials_equals_that_of_rows(txn01):
    by_step = rollup(txn01, ["step", "type"], powers=True)
    by_type = rollup(by_step, ["type"], m=PARTIALS, powers=True)
    want = dq.outlier_cutoff(txn01).first()
    for partials in (by_step, by_type):
        assert dq.outlier_cutoff(partials, m=PARTIALS).first() == want
    given = dq.amount_outliers(txn01, cutoff=dq.outlier_cutoff(by_type, m=PARTIALS))
    assert given.count() == 183
    scans = given._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in scans


@pytest.mark.parametrize("amounts", [[], [1.0], [None], [2.0, None, 4.0], [1e12 + i / 100 for i in range(50)], [5.0] * 40, [-1.25, 3.5, 1e9]])
def test_cutoff_against_exact_arithmetic(spark, amounts):
    df = spark.createDataFrame([(a,) for a in amounts], "amount double")
    got = dq.outlier_cutoff(df, 2.0).first()
    d = [Decimal(str(round(a, 2))) for a in amounts if a is not None]
    if not d:
        assert got is None
        assert dq.amount_outliers(spark.createDataFrame([], TXN_SCHEMA)).count() == 0
        return
    mean = sum(d) / len(d)
    assert got.amount_rows == len(d) and math.isclose(got.mean_amount, mean, rel_tol=1e-15, abs_tol=1e-12)
    if len(d) == 1:
        assert got.stddev_amount is None and got.cutoff is None
    else:
        dev = (sum((x - mean) ** 2 for x in d) / (len(d) - 1)).sqrt()
        assert math.isclose(got.stddev_amount, dev, rel_tol=1e-12, abs_tol=1e-12)  # no cancellation, however far the mean


def test_cutoff_with_other_money_scales(spark):
    df = spark.createDataFrame([(0.001 * i,) for i in range(100)], "amount double")
    with money_scale(3):
        assert math.isclose(dq.outlier_cutoff(df).first().mean_amount, 0.0495)


def _plain(rows, rules):
    """The comparison from the definition."""
    def flags(rule, r):
        return r.amount is not None and r.amount > rule.min_amount and (not rule.types or r.type in rule.types) and not (rule.unless and flags(rule.unless, r))

    out = {}
    for rule in rules:
        hit = [r for r in rows if flags(rule, r)]
        cents = lambda some: sum(Decimal(str(round(r.amount, 2))) for r in some)
        fraud, legit = [r for r in hit if r.isFraud == 1], [r for r in hit if r.isFraud == 0]
        sums = [float(cents(hit)), len(fraud), float(cents(fraud)), len(legit), float(cents(legit))] if hit else [None] * 5
        out[rule.name] = (len(hit), *sums)
    return out


def test_many_rules_against_the_definition(txn01):
    rules = [th.Rule(f"any > {c}", float(c)) for c in range(0, 900_000, 9001)]
    rules += [th.Rule(f"types > {c}", float(c), ("TRANSFER", "CASH_OUT")) for c in range(500, 900_000, 20_011)]
    rules += [th.Rule(f"rest > {c}", float(c), ("TRANSFER", "DEBIT", "none"), unless=rules[7]) for c in range(100, 500_000, 30_007)]
    rules += [th.Rule("negative", -100.0), th.Rule("nothing", 1e15), th.Rule("unseen type", 1.0, ("none",)), th.Rule("undone", 5e5, ("DEBIT",), unless=th.Rule("x", 1.0))]
    got = th.compare_many(txn01, rules, cell=16)
    names = ["flagged_transactions", "flagged_value", "fraud_captured_count", "fraud_captured_value", "legit_affected_count", "legit_affected_value"]
    rows = got.collect()
    assert {r.threshold_name: tuple(r[n] for n in names) for r in rows} == _plain(txn01.collect(), rules)
    one_list = th.compare(txn01, rules)
    assert got.columns == one_list.columns and got.dtypes == one_list.dtypes
    assert [tuple(r) for r in rows] == [tuple(r) for r in one_list.collect()]


def test_many_cuts_take_the_linear_plan(spark, txn01, monkeypatch):
    rules = [th.Rule(f"> {c}", float(c)) for c in range(12)]
    want = [tuple(r) for r in th.compare(txn01, rules).collect()]
    monkeypatch.setattr(th, "MANY_CUTS", 10)
    monkeypatch.setattr(th, "CELL", 4)
    assert [tuple(r) for r in th.compare(txn01, rules).collect()] == want
    empty = th.compare(txn01.limit(0), rules).collect()
    assert [(r.flagged_transactions, r.flagged_value, r.total_txns_flagged_pct) for r in empty] == [(0, None, None)] * 12


def _csv(spark, lines):
    path = f"{scratch_path(spark, 'test-csv')}/in.csv"
    files.write_text(spark, path, "\n".join(lines) + "\n")
    return path


def test_good_rows_and_rejects_make_up_the_lines(spark):
    header = ",".join(TXN_COLUMNS)
    good = ["1,PAYMENT,9839.64,C1,170136.0,160296.36,M1,0.0,0.0,0,0", "2,TRANSFER,,C2,1.0,1.0,C3,,,1,0", '3,"A,B",1.0,C2,1.0,1.0,C3,0,0,1,0']
    bad = {
        "4,PAYMENT,abc,C1,1.0,1.0,M1,0.0,0.0,0,0": "amount is no double",
        "5,PAYMENT,1.0,C1,1.0,1.0,M1,0.0": "8 fields instead of 11",
        "6,PAYMENT,1.0,C1,1.0,1.0,M1,0.0,0.0,0,0,9": "12 fields instead of 11",
        "x,PAYMENT,1.0,C1,1.0,1.0,M1,0.0,0.0,0,0": "step is no bigint",
        "7,PAYMENT,1.0,C1,1.0,1.0,M1,0.0,0.0,0,no": "isFlaggedFraud is no bigint",
    }
    path = _csv(spark, [header, *good[:2], *bad, good[2]])
    out = scratch_path(spark, "test-landing")
    landing = land_csv(spark, path, out)
    assert (landing.good_rows, landing.rejected_rows) == (3, 5)
    rows = read_landing(spark, out)
    assert rows.schema == TXN_SCHEMA and sorted(r.step for r in rows.collect()) == [1, 2, 3]
    rejects = read_rejects(spark, out).collect()
    assert {r.line: r.reason for r in rejects} == bad and all(r.file.endswith("in.csv") for r in rejects)
    with pytest.raises(Exception):  # noqa: B017  FAILFAST stays the default of the plain reader
        read_transactions(spark, path, "csv").collect()

    with pytest.raises(TooManyRejects, match="5 lines"):
        land_csv(spark, path, out, max_rejects=4)
    assert read_landing(spark, out).count() == 3  # the earlier landing
    assert land_csv(spark, path, out, max_rejects=5).rejected_rows == 5


def test_landing_without_rejects_and_without_rows(spark, txn01):
    out = scratch_path(spark, "test-landing")
    with pytest.raises(FileNotFoundError):
        read_landing(spark, out)
    assert land_csv(spark, _csv(spark, [";".join(reversed(TXN_COLUMNS)) + ";more"]), out, ";").good_rows == 0
    assert read_landing(spark, out).count() == 0 and read_rejects(spark, out).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        land_csv(spark, _csv(spark, ["a,b", "1,2"]), out)
