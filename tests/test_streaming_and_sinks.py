"""Stream = batch (closed windows only), exports round trip, sources read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fraudscope.operators import monitoring as mon
from fraudscope.operators import thresholds as th
from fraudscope.session import scratch_path
from fraudscope.sinks import export_all, read_export, versions
from fraudscope.sources import land_parquet, read_transactions, stream_fixture
from fraudscope.streaming import jobs as st
from tests.conftest import SF01


def test_stream_weekly_equals_batch_on_closed_windows(spark, txn01):
    base = scratch_path(spark, "test-st1")
    q = st.start_window_partials(stream_fixture(spark, SF01), f"{base}/d", f"{base}/c", available_now=True)
    st.run_to_end(q)
    streamed = st.metrics_from_partials(spark.read.parquet(f"{base}/d"))
    batch = mon.weekly_metrics(txn01)
    closed = [tuple(r) for r in batch.collect()][:4]
    assert [tuple(r) for r in streamed.collect()] == closed


def test_stream_queue_equals_batch(spark, txn01):
    base = scratch_path(spark, "test-st2")
    q = st.start_review_queue(stream_fixture(spark, SF01), f"{base}/d", f"{base}/c", available_now=True)
    st.run_to_end(q)
    got = spark.read.parquet(f"{base}/d").groupBy("review_queue").count()
    want = th.review_queue(txn01).groupBy("review_queue").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_restart_does_not_duplicate(spark):
    base = scratch_path(spark, "test-st3")
    for _ in range(2):  # second run resumes from the checkpoint: nothing new
        q = st.start_alerts(stream_fixture(spark, SF01), base, f"{base}/c", 24, available_now=True)
        st.run_to_end(q)
    alerts = versions.read_current(spark, base, "alert_fraud_rate_spike")
    assert alerts.count() == 28
    assert alerts.select("period").distinct().count() == 28


def test_export_all_round_trip(spark, txn01):
    out = scratch_path(spark, "test-exports")
    paths = export_all(txn01, out)
    assert len(paths) == 8
    text = spark.read.text(paths["page3_threshold_comparison.txt"]).collect()
    assert text[0].value.startswith("threshold_name\tflagged_transactions")
    assert "E1" not in "".join(r.value for r in text)  # money as plain decimals
    table = th.compare(txn01)
    back = read_export(spark, paths["page3_threshold_comparison.txt"], table.schema)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in table.collect()]
    semi = spark.read.option("header", True).option("sep", ";").csv(paths["executive_summary_dashboard.csv"])
    assert semi.count() == 1


def test_csv_and_parquet_sources(spark, txn01):
    base = scratch_path(spark, "test-src")
    txn01.write.mode("overwrite").option("header", True).csv(f"{base}/csv")
    back = read_transactions(spark, f"{base}/csv", fmt="csv")
    assert back.schema == txn01.schema or back.columns == txn01.columns
    assert back.exceptAll(txn01).count() == 0 and txn01.exceptAll(back).count() == 0
    land_parquet(txn01.withColumn("period", F.expr("(step - 1) div 168")), f"{base}/pq", ["period"])
    pq = read_transactions(spark, f"{base}/pq")
    assert pq.count() == 10020


def test_dashboard_from_rollup_equals_direct(txn01):
    from fraudscope.functions.bands import with_bands
    from fraudscope.operators import segments as seg
    from fraudscope.sinks.export import dashboard_tables

    banded = with_bands(txn01)
    direct = {
        "executive_summary_dashboard.txt": seg.executive_summary(txn01),
        "page1_fraud_trend_by_step.csv": seg.trend_by_step(txn01),
        "page2_fraud_by_amount_band.txt": seg.by_amount_band(banded),
        "page2_top_risk_segments.txt": seg.top_risk(banded),
        "page2_fraud_by_origin_balance_band.txt": seg.by_origin_balance_band(banded),
        "page3_threshold_comparison.txt": th.compare(txn01),
    }
    tables = dashboard_tables(txn01)
    for name, want in direct.items():
        got = tables[name]
        assert got.columns == want.columns, name
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()], name


def test_stream_partials_give_every_monitoring_table(spark, txn01):
    base = scratch_path(spark, "test-st-all")
    q = st.start_window_partials(stream_fixture(spark, SF01), f"{base}/d", f"{base}/c", 24, available_now=True)
    st.run_to_end(q)
    partials = spark.read.parquet(f"{base}/d")
    closed = partials.agg(F.max("period")).first()[0]
    pairs = [
        (mon.threshold_from_rollup(partials, 24, spine=False), mon.weekly_threshold(txn01, 24)),
        (mon.rate_by_type_from_rollup(partials, 24, spine=False), mon.weekly_rate_by_type(txn01, 24)),
        (mon.concentration_from_rollup(partials), mon.value_concentration(txn01, 24)),
    ]
    for got, want in pairs:
        # the batch tables are spine-filled; a stream only knows windows that saw rows
        want = want.where(F.col("period") <= closed)
        if "total_transactions" in want.columns:
            want = want.where(F.col("total_transactions") > 0)
        key = lambda r: [(v is None, str(v)) for v in r]
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_sql_views(spark, txn01):
    from fraudscope.sources import register_views

    register_views(txn01)
    r = spark.sql(
        "SELECT amount_band, COUNT(*) AS n FROM transactions_segmented GROUP BY amount_band ORDER BY n DESC"
    ).collect()
    assert sum(x.n for x in r) == 10020
    assert spark.sql("SELECT COUNT(*) FROM transactions WHERE isFlaggedFraud = 1").first()[0] == 347


def test_row_tables_and_period_pruning(spark, txn01):
    from fraudscope.sinks import export_row_tables
    from fraudscope.sources import land_by_period, read_periods

    out = scratch_path(spark, "test-rows")
    paths = export_row_tables(txn01, out)
    assert spark.read.parquet(paths["review_queue"]).count() == 10020
    assert spark.read.parquet(paths["amount_outliers"]).count() == 183
    assert spark.read.parquet(paths["invalid_amounts"]).count() == 20

    landed = scratch_path(spark, "test-periods")
    land_by_period(txn01, landed)
    week2 = read_periods(spark, landed, [2])
    plan = week2._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "period" in plan
    want = mon.weekly_metrics(txn01).where("period = 2").drop("period_start_step").collect()
    got = mon.weekly_metrics(week2.drop("period")).where("period = 2").drop("period_start_step").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_publish_all_equals_direct(spark, txn01):
    from fraudscope.sinks import publish_all

    out = scratch_path(spark, "test-publish")
    paths = publish_all(txn01, out, period_hours=24, capacity=50)
    key = lambda r: [(v is None, str(v)) for v in r]
    direct = {
        "weekly_metrics": mon.weekly_metrics(txn01, 24),
        "weekly_rate_by_type": mon.weekly_rate_by_type(txn01, 24),
        "weekly_threshold": mon.weekly_threshold(txn01, 24),
        "alert_fraud_rate_spike": mon.fraud_rate_spike(mon.weekly_metrics(txn01, 24)),
        "alert_value_concentration": mon.value_concentration(txn01, 24),
        "alert_capacity_breach": mon.capacity_breach(mon.weekly_threshold(txn01, 24), 50),
    }
    for name, want in direct.items():
        got = spark.read.parquet(paths[name])
        assert got.columns == want.columns, name
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key), name
    assert spark.read.parquet(paths["quality_report"]).count() == 1
    assert len([k for k in paths if "." in k]) == 8


def test_export_writes_plain_numbers(spark):
    from fraudscope.sinks import export

    df = spark.createDataFrame(
        [("a", 0.0002, 0.0, 24.7191, 1144392944759.77, None)],
        "k string, r1 double, r2 double, r3 double, total_value double, r4 double",
    )
    path = f"{scratch_path(spark, 'test-plain')}/t.txt"
    export(df, path, "\t")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[1] == "a\t0.0002\t0.0\t24.7191\t1144392944759.77\t"
    back = read_export(spark, path, df.schema)
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_stream_alerts_cover_every_alert(spark, txn01):
    base = scratch_path(spark, "test-st-all-alerts")
    q = st.start_alerts(stream_fixture(spark, SF01), base, f"{base}/c", 24, available_now=True, capacity=50)
    st.run_to_end(q)
    closed = versions.read_current(spark, base, "weekly_metrics").agg(F.max("period")).first()[0]
    batch = {
        "alert_review_surge": mon.review_surge(mon.weekly_threshold(txn01, 24)),
        "alert_cash_out_spike": mon.week_over_week(mon.weekly_rate_by_type(txn01, 24), "CASH_OUT"),
        "alert_capacity_breach": mon.capacity_breach(mon.weekly_threshold(txn01, 24), 50),
    }
    for name, want in batch.items():
        got = versions.read_current(spark, base, name)
        want = want.where(F.col("period") <= closed)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), name


def test_duplicates_in_one_job(spark, txn01):
    from fraudscope.operators import quality as dq

    path = scratch_path(spark, "test-dups")
    summary = dq.write_duplicates(txn01, path)
    want = dq.duplicate_summary(txn01).first().asDict()
    assert summary == want
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, dq.duplicate_groups(txn01).collect()), key=str)


def test_stream_of_landed_transaction_files(spark, txn01):
    from fraudscope.sources import stream_transactions

    base = scratch_path(spark, "test-st-landed")
    # a feed lands in time order: one file per slice of steps, written one after
    # another (a shuffled backlog would run ahead of the watermark and drop
    # rows; replay such a backlog through the batch jobs)
    for lo in range(0, 720, 144):
        txn01.where(f"step > {lo} AND step <= {lo + 144}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = stream_transactions(spark, f"{base}/in", max_files_per_trigger=2)
    q = st.start_window_partials(stream, f"{base}/d", f"{base}/c", available_now=True)
    st.run_to_end(q)
    got = [tuple(r) for r in st.metrics_from_partials(spark.read.parquet(f"{base}/d")).collect()]
    want = [tuple(r) for r in mon.weekly_metrics(txn01).collect()][: len(got)]
    assert len(got) == 4 and got == want


def test_interleaved_files_raise_instead_of_losing_rows(spark, txn01):
    import pytest

    from fraudscope.sources import stream_transactions

    base = scratch_path(spark, "test-interleaved")
    txn01.repartition(8).write.parquet(f"{base}/in")
    q = st.start_window_partials(stream_transactions(spark, f"{base}/in"), f"{base}/one", f"{base}/c1", 24, available_now=True)
    st.run_to_end(q)  # all files are one batch: nothing is late
    assert spark.read.parquet(f"{base}/one").agg(F.sum("rows")).first()[0] > 9000
    q = st.start_window_partials(
        stream_transactions(spark, f"{base}/in", max_files_per_trigger=1), f"{base}/many", f"{base}/c2", 24, available_now=True
    )
    with pytest.raises(st.LateRowsDropped):
        st.run_to_end(q)


def test_quiet_periods_and_negative_steps_match_batch(spark):
    from fraudscope.schema import TXN_SCHEMA
    from fraudscope.sources import stream_transactions

    base = scratch_path(spark, "test-quiet")
    rows = [(s, "TRANSFER", 10.0, "C1", 0.0, 0.0, "C2", 0.0, 0.0, 0, 0) for s in (-30, -5, 0, 1, 25, 97, 400)]
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    df.write.parquet(f"{base}/in")
    q = st.start_window_partials(stream_transactions(spark, f"{base}/in"), f"{base}/d", f"{base}/c", 24, available_now=True)
    st.run_to_end(q)
    streamed = [tuple(r) for r in st.metrics_from_partials(spark.read.parquet(f"{base}/d"), 24).collect()]
    batch = [tuple(r) for r in mon.weekly_metrics(df, 24).collect()]
    assert [r[0] for r in batch] == list(range(-2, 17))
    assert streamed == batch[: len(streamed)] and len(streamed) >= 7


def test_alert_tables_exist_before_a_period_closes(spark):
    from fraudscope.schema import TXN_SCHEMA
    from fraudscope.sources import stream_transactions

    base = scratch_path(spark, "test-early")
    rows = [(s, "TRANSFER", 10.0, "C1", 0.0, 0.0, "C2", 0.0, 0.0, 0, 0) for s in (1, 2)]
    spark.createDataFrame(rows, TXN_SCHEMA).write.parquet(f"{base}/in")
    q = st.start_alerts(stream_transactions(spark, f"{base}/in"), base, f"{base}/c", 24, available_now=True)
    st.run_to_end(q)
    assert versions.read_current(spark, base, "alert_fraud_rate_spike").count() == 0


def test_csv_is_read_by_header_name(spark, txn01):
    import pytest

    base = scratch_path(spark, "test-header")
    few = txn01.limit(50)
    few.select(*reversed(few.columns), F.lit("x").alias("extra")).write.option("header", True).csv(f"{base}/swapped")
    back = read_transactions(spark, f"{base}/swapped", fmt="csv")
    assert back.columns == few.columns and back.exceptAll(few).count() == 0 and back.count() == 50
    few.drop("oldbalanceOrg").write.option("header", True).csv(f"{base}/short")
    with pytest.raises(ValueError, match="oldbalanceOrg"):
        read_transactions(spark, f"{base}/short", fmt="csv")


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    import pytest

    from fraudscope.session import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())
