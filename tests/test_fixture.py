"""Fixture shape: the expected values of FIXTURES.md section 3."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fraudscope.schema import TXN_COLUMNS
from tests.conftest import SF001, SF01


@pytest.mark.parametrize(
    "sf_dir,rows,distinct,null_amount,merchants,flagged",
    [(SF001, 1002, 1000, 3, 203, 40), (SF01, 10020, 10000, 12, 1981, 347)],
)
def test_counts(spark, sf_dir, rows, distinct, null_amount, merchants, flagged):
    from fraudscope.sources import transactions

    df = transactions(spark, sf_dir)
    assert df.columns == TXN_COLUMNS
    r = df.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.struct(*TXN_COLUMNS)).alias("d"),
        F.count_if(F.col("amount").isNull()).alias("na"),
        F.count_if(F.col("nameDest").startswith("M")).alias("m"),
        F.sum("isFlaggedFraud").alias("f"),
    ).first()
    assert (r.n, r.d, r.na, r.m, r.f) == (rows, distinct, null_amount, merchants, flagged)


def test_types_per_fixture(txn01):
    got = {r["type"]: r["count"] for r in txn01.groupBy("type").count().collect()}
    assert got == {"CASH_IN": 2022, "CASH_OUT": 2007, "DEBIT": 1988, "PAYMENT": 1978, "TRANSFER": 2014, None: 11}


def test_step_range(txn01):
    r = txn01.agg(F.min("step"), F.max("step"), F.count_distinct("step")).first()
    assert tuple(r) == (1, 720, 720)


def test_step_is_zone_independent(spark):
    from fraudscope.sources import transactions

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la = transactions(spark, SF001).agg(F.sum("step")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert la == transactions(spark, SF001).agg(F.sum("step")).first()[0]
