"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Every query reads the ``events`` table of the scale-factor folder and derives
the transaction table from it (``sources.fixture``), so its work grows with the
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.functions.bands import with_bands
from fraudscope.functions.measures import PARTIALS, rollup
from fraudscope.operators import monitoring as mon
from fraudscope.operators import quality as dq
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th
from fraudscope.operators.ledger import RowLedger
from fraudscope.schema import HOURS_PER_WEEK
from fraudscope.session import scratch_path
from fraudscope.sinks import export, period_store, read_export, versions
from fraudscope.sinks.export import DASHBOARD_FILES, dashboard_tables
from fraudscope.sources import land_by_period, land_csv, preview, read_landing, read_rejects, read_transactions, stream_fixture, stream_transactions, transactions
from fraudscope.streaming import feed
from fraudscope.streaming import jobs as st

# Alert keys evaluate daily periods: the 30-day fixture then has 30 periods,
# enough for the 4-period baselines (weekly would leave one evaluable week).
ALERT_PERIOD_HOURS = 24
ALERT_CAPACITY = 50

Query = Callable[[SparkSession, str], DataFrame]


def _on_txn(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(transactions(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


def _on_seg(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_txn(lambda df: fn(with_bands(df)))


#: A sweep of 300 cut-offs over the review types.
SWEEP_RULES = tuple(th.Rule(f"TRANSFER/CASH_OUT > {k}K", k * 1000.0, ("TRANSFER", "CASH_OUT")) for k in range(3, 903, 3))

#: A sweep of 20,000 cut-offs over the review types.
MANY_RULES = 20_000


def _sweep_many(df: DataFrame) -> DataFrame:
    """TH-6 with 20,000 rules: suffix sums over ordered buckets."""
    return th.compare(df, [th.Rule(f"TRANSFER/CASH_OUT > {45 * k}", 45.0 * k, ("TRANSFER", "CASH_OUT")) for k in range(1, MANY_RULES + 1)])


def _outlier_cutoff(df: DataFrame) -> DataFrame:
    """DQ-17: the cut-off from power sums of a rollup by step and type."""
    sums = rollup(df, ["step", "type"], powers=True)
    found = dq.outlier_cutoff(sums, m=PARTIALS)
    return found.select("amount_rows", *[F.round(c, 4).alias(c) for c in ("mean_amount", "stddev_amount", "cutoff")])


QUERIES: dict[str, Query] = {
    # --- sources and views (SRC-1, 3, 4) ---
    "scan_transactions": _on_txn(lambda df: df),
    "preview": _on_txn(preview),
    "segmented_view": _on_txn(with_bands),
    # --- data quality (DQ-1..24) ---
    "dq_missing_values": _on_txn(dq.missing_values),
    "dq_merchant_missing": _on_txn(dq.merchant_missing),
    "dq_duplicate_summary": _on_txn(dq.duplicate_summary),
    "dq_duplicate_groups": _on_txn(dq.duplicate_groups),
    "dq_invalid_amount_counts": _on_txn(dq.invalid_amount_counts),
    "dq_invalid_amount_rows": _on_txn(dq.invalid_amount_rows),
    "dq_amount_stats": _on_txn(dq.amount_stats),
    "dq_top_amounts": _on_txn(dq.top_amounts),
    "dq_origin_balance_mismatch_count": _on_txn(dq.origin_mismatch_count),
    "dq_origin_balance_mismatch_rows": _on_txn(dq.origin_mismatch_rows),
    "dq_dest_balance_mismatch_count": _on_txn(dq.dest_mismatch_count),
    "dq_dest_balance_mismatch_rows": _on_txn(dq.dest_mismatch_rows),
    "dq_negative_balances": _on_txn(dq.negative_balances),
    "dq_fraud_distribution": _on_txn(dq.fraud_distribution),
    "dq_type_by_label": _on_txn(dq.type_by_label),
    "dq_fraud_rate_by_type": _on_txn(seg.fraud_rate_by_type),
    "dq_amount_outliers": _on_txn(dq.amount_outliers),
    "dq_outlier_cutoff": _on_txn(_outlier_cutoff),
    "dq_flagged_rows": _on_txn(dq.flagged_rows),
    "dq_flagged_stats": _on_txn(dq.flagged_stats),
    "dq_flagged_by_type": _on_txn(dq.flagged_by_type),
    "dq_unflagged_large_transfers": _on_txn(dq.unflagged_large_transfers),
    "dq_unflagged_fraud_transfers": _on_txn(dq.unflagged_fraud_transfers),
    "dq_zero_origin_balance": _on_txn(dq.zero_origin_balance),
    "dq_zero_dest_balance": _on_txn(dq.zero_dest_balance),
    "dq_report": _on_txn(dq.report),
    # --- KPIs (KPI-1..4) ---
    "kpi_by_type": _on_txn(seg.kpi_by_type),
    "kpi_overall": _on_txn(seg.kpi_overall),
    "kpi_executive_summary": _on_txn(seg.executive_summary),
    "kpi_trend_by_step": _on_txn(seg.trend_by_step),
    # --- segmentation (SEG-1..9) ---
    "seg_by_type": _on_seg(seg.by_type),
    "seg_by_amount_band": _on_seg(seg.by_amount_band),
    "seg_by_origin_balance_band": _on_seg(seg.by_origin_balance_band),
    "seg_by_zero_balance_flag": _on_seg(seg.by_zero_balance_flag),
    "seg_type_amount": _on_seg(lambda df: seg.combined(df, ["type", "amount_band"])),
    "seg_type_balance": _on_seg(lambda df: seg.combined(df, ["type", "origin_balance_band"])),
    "seg_type_amount_balance": _on_seg(
        lambda df: seg.combined(df, ["type", "amount_band", "origin_balance_band"])
    ),
    "seg_fraud_share": _on_seg(seg.fraud_share),
    "seg_top_risk": _on_seg(seg.top_risk),
    # --- thresholds (TH-1..7) ---
    "th_base_totals": _on_txn(th.base_totals),
    "th_compare_ab": _on_txn(lambda df: th.compare(df, (th.RULE_A, th.RULE_B))),
    "th_detail_a": _on_txn(lambda df: th.rule_detail(df, th.RULE_A)),
    "th_detail_b": _on_txn(lambda df: th.rule_detail(df, th.RULE_B)),
    "th_compare_c": _on_txn(lambda df: th.compare(df, (th.RULE_C,))),
    "th_sweep": _on_txn(lambda df: th.compare(df, SWEEP_RULES)),
    "th_sweep_many": _on_txn(_sweep_many),
    "th_compare_abc": _on_txn(lambda df: th.compare(df, th.DASHBOARD_RULES)),
    "review_queue": _on_txn(th.review_queue),
}


def _export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8 written as tab-separated text, then read back with its schema."""
    table = th.compare(transactions(spark, sf_dir), th.DASHBOARD_RULES)
    path = f"{scratch_path(spark, 'export')}/page3_threshold_comparison.txt"
    export(table, path, "\t")
    return read_export(spark, path, table.schema, "\t")


def _stream_weekly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1: closed weekly windows from the event stream, rolled up on read."""
    base = scratch_path(spark, "st-weekly")
    q = st.start_window_partials(stream_fixture(spark, sf_dir), f"{base}/data", f"{base}/_checkpoint", available_now=True)
    st.run_to_end(q)
    return st.metrics_from_partials(spark.read.parquet(f"{base}/data"))


def _stream_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-2: every streamed transaction routed to its queue."""
    base = scratch_path(spark, "st-queue")
    q = st.start_review_queue(stream_fixture(spark, sf_dir), f"{base}/data", f"{base}/_checkpoint", available_now=True)
    st.run_to_end(q)
    return spark.read.parquet(f"{base}/data")


def _stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: daily fraud-rate spike alerts over the closed periods of the stream."""
    base = scratch_path(spark, "st-alerts")
    q = st.start_alerts(
        stream_fixture(spark, sf_dir),
        base,
        f"{base}/_checkpoint",
        ALERT_PERIOD_HOURS,
        available_now=True,
        tables=("alert_fraud_rate_spike",),
    )
    st.run_to_end(q)
    return versions.read_current(spark, base, "alert_fraud_rate_spike")


def _stream_table(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch_path(spark, "st-table")
        q = st.start_alerts(
            stream_fixture(spark, sf_dir),
            base,
            f"{base}/_checkpoint",
            ALERT_PERIOD_HOURS,
            available_now=True,
            capacity=ALERT_CAPACITY,
            tables=(name,),
        )
        st.run_to_end(q)
        return versions.read_current(spark, base, name)

    run.__doc__ = f"ST-3: {name} over the closed daily periods of the stream."
    return run


def _scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1 from CSV: the table written with its columns in another order, read by the header's names."""
    path = scratch_path(spark, "csv")
    df = transactions(spark, sf_dir)
    df.select(*reversed(df.columns)).write.option("header", True).csv(path)
    return read_transactions(spark, path, "csv")


def _feed_table(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = scratch_path(spark, "st-feed")
        dealt = transactions(spark, sf_dir).repartition(3, F.xxhash64("nameOrig", "amount"))
        dealt.write.parquet(f"{base}/in")
        stream = stream_transactions(spark, f"{base}/in", max_files_per_trigger=1)
        st.run_to_end(feed.start_feed(stream, f"{base}/out", f"{base}/_checkpoint", available_now=True, tables=(name,)))
        return feed.feed_tables(spark, f"{base}/out", tables=(name,))[name]

    run.__doc__ = f"ST-1: {name} of a feed whose files interleave all weeks, one a batch; late rows are merged into closed weeks."
    return run


def _incremental(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, txn = scratch_path(spark, "mon-store"), transactions(spark, sf_dir)
        old = F.col("step") <= 3 * HOURS_PER_WEEK
        land_by_period(txn.where(old), f"{base}/landed")
        period_store.refresh(spark, f"{base}/landed", f"{base}/store")
        land_by_period(txn.where(~old | F.col("step").isNull()), f"{base}/landed", mode="append")
        period_store.refresh(spark, f"{base}/landed", f"{base}/store")  # reads the new weeks only
        return period_store.store_tables(spark, f"{base}/store", tables=(name,))[name]

    run.__doc__ = f"{name} from the store of period partials, after new weeks were landed beside the old ones."
    return run


def _ledger(spark: SparkSession, sf_dir: str) -> RowLedger:
    """The table in two landings that share repeated rows, taken in one after the other."""
    path = scratch_path(spark, "ledger")
    ledger = RowLedger(spark, f"ledger_{path[-32:]}", path, buckets=8)
    dealt = transactions(spark, sf_dir).withColumn("_landing", F.monotonically_increasing_id() % 2)
    for i in (0, 1):
        ledger.add(dealt.where(F.col("_landing") == i), f"landing-{i}")
    return ledger


def _ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-3 over two landings, each hashed once."""
    return _ledger(spark, sf_dir).summary()


def _ledger_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-4 over two landings, each hashed once."""
    return _ledger(spark, sf_dir).groups()


def _with_spoilt_rows(spark: SparkSession, sf_dir: str) -> str:
    """The table as a CSV in which some amounts and some labels are no numbers, landed with its rejects."""
    base, txn = scratch_path(spark, "csv-rejects"), transactions(spark, sf_dir)
    text = txn.select(*[F.col(c).cast("string").alias(c) for c in txn.columns])
    amount = F.when(F.col("step") % 97 == 0, F.lit("n/a")).otherwise(F.col("amount"))
    label = F.when(F.col("step") % 89 == 0, F.lit("maybe")).otherwise(F.col("isFraud"))
    text.withColumns({"amount": amount, "isFraud": label}).write.option("header", True).csv(f"{base}/in")
    land_csv(spark, f"{base}/in", f"{base}/out")
    return f"{base}/out"


def _scan_csv_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: the rows that could be read of a CSV with malformed ones."""
    return read_landing(spark, _with_spoilt_rows(spark, sf_dir))


def _scan_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1: the rejected lines of the same CSV by reason."""
    rejects = read_rejects(spark, _with_spoilt_rows(spark, sf_dir))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected_rows"))


def _export_key(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = dashboard_tables(transactions(spark, sf_dir))[name]
        path = f"{scratch_path(spark, 'export')}/{name}"
        export(table, path, DASHBOARD_FILES[name])
        return read_export(spark, path, table.schema, DASHBOARD_FILES[name])

    run.__doc__ = f"{name}: written as a delimited file, then read back."
    return run


QUERIES.update(
    {
        "scan_csv_roundtrip": _scan_csv_roundtrip,
        "scan_csv_good": _scan_csv_good,
        "dq_ledger_summary": _ledger_summary,
        "dq_ledger_groups": _ledger_groups,
        "scan_csv_rejects": _scan_csv_rejects,
        # --- sinks ---
        "export_roundtrip": _export_roundtrip,
        "export_summary_csv": _export_key("executive_summary_dashboard.csv"),
        "export_trend_by_step": _export_key("page1_fraud_trend_by_step.csv"),
        "export_summary_txt": _export_key("executive_summary_dashboard.txt"),
        "export_fraud_by_type": _export_key("page2_fraud_by_type.txt"),
        "export_fraud_by_amount_band": _export_key("page2_fraud_by_amount_band.txt"),
        "export_top_risk_segments": _export_key("page2_top_risk_segments.txt"),
        "export_fraud_by_origin_balance_band": _export_key("page2_fraud_by_origin_balance_band.txt"),
        # --- monitoring (MON-1..10), weekly ---
        "mon_weekly_metrics": _on_txn(mon.weekly_metrics),
        "mon_weekly_rate_by_type": _on_txn(mon.weekly_rate_by_type),
        "mon_weekly_threshold": _on_txn(mon.weekly_threshold),
        "mon_incremental_metrics": _incremental("weekly_metrics"),
        "mon_incremental_rate_by_type": _incremental("weekly_rate_by_type"),
        "mon_incremental_threshold": _incremental("weekly_threshold"),
        # --- alerts (AL-1..6), daily periods ---
        "alert_fraud_rate_spike": _on_txn(
            lambda df: mon.fraud_rate_spike(mon.weekly_metrics(df, ALERT_PERIOD_HOURS, ordered=False))
        ),
        "alert_transfer_spike": _on_txn(
            lambda df: mon.type_spike(mon.weekly_rate_by_type(df, ALERT_PERIOD_HOURS, ordered=False), "TRANSFER")
        ),
        "alert_cash_out_spike": _on_txn(
            lambda df: mon.week_over_week(mon.weekly_rate_by_type(df, ALERT_PERIOD_HOURS, ordered=False), "CASH_OUT")
        ),
        "alert_review_surge": _on_txn(
            lambda df: mon.review_surge(mon.weekly_threshold(df, ALERT_PERIOD_HOURS, ordered=False))
        ),
        "alert_value_concentration": _on_txn(lambda df: mon.value_concentration(df, ALERT_PERIOD_HOURS)),
        "alert_capacity_breach": _on_txn(
            lambda df: mon.capacity_breach(mon.weekly_threshold(df, ALERT_PERIOD_HOURS, ordered=False), ALERT_CAPACITY)
        ),
        # --- streaming twins (ST-1..3) ---
        "stream_weekly_metrics": _stream_weekly_metrics,
        "stream_review_queue": _stream_review_queue,
        "stream_alerts": _stream_alerts,
        "stream_rate_by_type": _stream_table("weekly_rate_by_type"),
        "stream_threshold": _stream_table("weekly_threshold"),
        "stream_transfer_spike": _stream_table("alert_transfer_spike"),
        "stream_cash_out_spike": _stream_table("alert_cash_out_spike"),
        "stream_review_surge": _stream_table("alert_review_surge"),
        "stream_value_concentration": _stream_table("alert_value_concentration"),
        "stream_capacity_breach": _stream_table("alert_capacity_breach"),
        "feed_weekly_metrics": _feed_table("weekly_metrics"),
        "feed_rate_by_type": _feed_table("weekly_rate_by_type"),
        "feed_threshold": _feed_table("weekly_threshold"),
    }
)
