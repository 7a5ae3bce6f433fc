"""Fraud KPIs and risk segmentation (KPI-1..4, SEG-1..9, DQ-16).

All of them are one ``groupBy().agg()`` over the (banded) transaction table:
scan -> partial hash aggregate in every task -> shuffle of one row per group
per task -> final aggregate. A hot key (one type holding a third of all rows)
costs nothing extra: map-side partial aggregation collapses it to one row per
task before the shuffle. Group counts are bounded by the band/type domain,
so post-aggregate steps (windows, top-k) run on a handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudscope.functions.bands import AMOUNT_BAND, BALANCE_BAND, BandSpec, with_bands
from fraudscope.functions.exprs import pct
from fraudscope.functions.measures import ROWS, PartialMeasures, RowMeasures
from fraudscope.schema import MIN_SEGMENT_ROWS, TOP_SEGMENTS

Measures = RowMeasures | PartialMeasures


def segment_metrics(
    df: DataFrame,
    by: Sequence[str],
    *,
    with_value: bool = True,
    min_count: int = 0,
    require_fraud: bool = False,
    m: Measures = ROWS,
) -> DataFrame:
    """Volume, value, fraud count / value / rate per segment.

    ``fraud_count`` is ``SUM(isFraud)``: NULL for a segment whose labels are all
    NULL. ``min_count`` / ``require_fraud`` act after aggregation (HAVING).
    ``m=PARTIALS`` reads a rollup instead of transaction rows.
    """
    aggs = [m.rows().alias("total_transactions")]
    if with_value:
        aggs.append(m.value().cast("double").alias("total_value"))
    aggs += [
        m.label_sum().alias("fraud_count"),
        m.fraud_value().cast("double").alias("fraud_value"),
    ]
    out = df.groupBy(*by).agg(*aggs).withColumn(
        "fraud_rate_pct", pct("fraud_count", "total_transactions", 4)
    )
    if min_count:
        out = out.where(F.col("total_transactions") >= min_count)
    if require_fraud:
        out = out.where(F.col("fraud_count") > 0)
    return out


def _risk_order(keys: Sequence[str], *extra: str) -> list[Column]:
    return (
        [F.desc_nulls_last("fraud_rate_pct"), F.desc_nulls_last("fraud_value")]
        + [F.desc_nulls_last(c) for c in extra]
        + [F.asc_nulls_last(k) for k in keys]
    )


# ---------------------------------------------------------------- KPIs -----


def kpi_by_type(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    """KPI-1: per type, by fraud rate descending."""
    return (
        segment_metrics(df, ["type"], m=m)
        .select("type", "total_transactions", "fraud_count", "total_value", "fraud_value", "fraud_rate_pct")
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), F.asc_nulls_last("type"))
    )


def kpi_overall(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    """KPI-2: the same metrics for the whole table (one row)."""
    return segment_metrics(df, [], m=m).select(
        "total_transactions", "total_value", "fraud_count", "fraud_value", "fraud_rate_pct"
    )


def executive_summary(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    """KPI-3: overall totals, fraud share of value and the riskiest type.

    Two aggregation levels and no join: per type first (a few rows), then one
    global aggregate that sums the per-type partials exactly and picks the
    top type with ``min_by`` over an ordering struct (rate desc, fraud value
    desc, type asc; NULLs last). Empty input gives no row.
    """
    per_type = df.groupBy("type").agg(
        m.rows().alias("n"),
        m.label_sum().alias("label_sum"),
        m.fraud_rows().alias("fraud_n"),
        m.value().alias("value"),
        m.fraud_value().alias("fraud_value"),
    )
    rate = pct("label_sum", "n", 4)
    order_key = F.struct(
        rate.isNull(), -rate, F.col("fraud_value").isNull(), -F.col("fraud_value"),
        F.col("type").isNull(), F.col("type"),
    )
    summary = per_type.agg(
        F.sum("n").alias("total_transactions"),
        F.sum("value").cast("double").alias("total_transaction_value"),
        F.sum("fraud_n").alias("total_fraud_count"),
        F.sum("fraud_value").cast("double").alias("total_fraud_value"),
        F.min_by("type", order_key).alias("top_risk_transaction_type"),
    )
    return summary.where(F.col("total_transactions").isNotNull()).select(
        "total_transactions",
        "total_transaction_value",
        "total_fraud_count",
        "total_fraud_value",
        pct("total_fraud_count", "total_transactions", 4).alias("fraud_rate_pct"),
        pct("total_fraud_value", "total_transaction_value", 4).alias("fraud_value_rate_pct"),
        "top_risk_transaction_type",
    )


def trend_by_step(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    """KPI-4: metrics per hour step, ascending (one row per step)."""
    return (
        df.groupBy("step")
        .agg(
            m.rows().alias("total_transactions"),
            m.value().cast("double").alias("total_transaction_value"),
            m.fraud_rows().alias("fraud_count"),
            m.fraud_value().cast("double").alias("fraud_value"),
        )
        .withColumn("fraud_rate_pct", pct("fraud_count", "total_transactions", 4))
        .orderBy(F.asc_nulls_last("step"))
    )


def fraud_rate_by_type(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    """DQ-16: volume, fraud count and rate per type (narrow column set)."""
    return (
        df.groupBy("type")
        .agg(m.rows().alias("total_txns"), m.label_sum().alias("fraud_txns"))
        .withColumn("fraud_rate_pct", pct("fraud_txns", "total_txns", 4))
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), F.asc_nulls_last("type"))
    )


# -------------------------------------------------------- segmentation -----

_SIX = ["total_transactions", "total_value", "fraud_count", "fraud_value", "fraud_rate_pct"]


def by_type(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    """SEG-1: per type, rate desc then fraud value desc."""
    return segment_metrics(df, ["type"], m=m).select("type", *_SIX).orderBy(*_risk_order(["type"]))


def by_band(df: DataFrame, spec: BandSpec, m: Measures = ROWS) -> DataFrame:
    """SEG-2 / SEG-3: per band, in the band's natural order (not alphabetical)."""
    banded = df if spec.name in df.columns else df.withColumn(spec.name, spec.label())
    out = segment_metrics(banded, [spec.name], m=m).select(spec.name, *_SIX)
    return out.orderBy(F.asc_nulls_last(spec.rank()))


def by_amount_band(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    return by_band(df, AMOUNT_BAND, m)


def by_origin_balance_band(df: DataFrame, m: Measures = ROWS) -> DataFrame:
    return by_band(df, BALANCE_BAND, m)


def by_zero_balance_flag(df: DataFrame) -> DataFrame:
    """SEG-4: origin balance zero versus non-zero (no total value)."""
    flagged = df if "origin_balance_zero_flag" in df.columns else with_bands(df)
    return (
        segment_metrics(flagged, ["origin_balance_zero_flag"], with_value=False)
        .select("origin_balance_zero_flag", "total_transactions", "fraud_count", "fraud_value", "fraud_rate_pct")
        .orderBy(F.desc_nulls_last("origin_balance_zero_flag"))
    )


def combined(
    df: DataFrame, keys: Sequence[str], min_count: int = MIN_SEGMENT_ROWS, m: Measures = ROWS
) -> DataFrame:
    """SEG-5 / 6 / 7: type x band(s), segments with at least ``min_count`` rows."""
    banded = df if all(k in df.columns for k in keys) else with_bands(df)
    return (
        segment_metrics(banded, list(keys), min_count=min_count, m=m)
        .select(*keys, *_SIX)
        .orderBy(*_risk_order(keys, "total_transactions"))
    )


def fraud_share(df: DataFrame, min_count: int = MIN_SEGMENT_ROWS) -> DataFrame:
    """SEG-8: each segment's share of all fraud among the segments that survive HAVING.

    The filter runs before the window, so the denominator covers surviving
    segments only. The window has no partition key, but it runs after the
    aggregate on at most (types x bands) rows.
    """
    keys = ["type", "amount_band"]
    banded = df if "amount_band" in df.columns else with_bands(df)
    seg = (
        banded.groupBy(*keys)
        .agg(ROWS.rows().alias("total_transactions"), ROWS.label_sum().alias("fraud_count"))
        .where(F.col("total_transactions") >= min_count)
    )
    all_fraud = F.sum("fraud_count").over(Window.partitionBy())
    return seg.select(
        *keys,
        "total_transactions",
        "fraud_count",
        pct("fraud_count", F.nullif(all_fraud, F.lit(0)), 4).alias("share_of_total_fraud_pct"),
        pct("fraud_count", "total_transactions", 4).alias("fraud_rate_pct"),
    ).orderBy(
        F.desc_nulls_last("share_of_total_fraud_pct"),
        F.desc_nulls_last("fraud_rate_pct"),
        *[F.asc_nulls_last(k) for k in keys],
    )


def top_risk(
    df: DataFrame, min_count: int = MIN_SEGMENT_ROWS, limit: int = TOP_SEGMENTS, m: Measures = ROWS
) -> DataFrame:
    """SEG-9: the ``limit`` riskiest type x amount band x balance band segments.

    ``orderBy().limit()`` plans as TakeOrderedAndProject (per-task heaps).
    Segment keys break ties so the cut at ``limit`` is deterministic.
    """
    keys = ["type", "amount_band", "origin_balance_band"]
    banded = df if all(k in df.columns for k in keys) else with_bands(df)
    return (
        segment_metrics(banded, keys, with_value=False, min_count=min_count, require_fraud=True, m=m)
        .select(*keys, "total_transactions", "fraud_count", "fraud_value", "fraud_rate_pct")
        .orderBy(*_risk_order(keys))
        .limit(limit)
    )
