"""Late rows in a running feed, publishing in one step, and monitoring by increments."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from fraudscope import files
from fraudscope.operators import monitoring as mon
from fraudscope.operators import thresholds as th
from fraudscope.schema import TXN_COLUMNS, TXN_SCHEMA
from fraudscope.session import scratch_path
from fraudscope.sinks import export, period_store, versions
from fraudscope.sources import land_by_period, stream_transactions
from fraudscope.streaming import feed, watch
from fraudscope.streaming import jobs as st

TABLES = ("weekly_metrics", "weekly_rate_by_type", "weekly_threshold")


def _rows(steps):
    """One small transfer per step (None: no step)."""
    return [(s, "TRANSFER" if i % 2 else "CASH_OUT", 1000.0 * (i + 1), "C1", 0.0, 0.0, "C2", 0.0, 0.0, i % 3 == 0 and 1 or 0, 0) for i, s in enumerate(steps)]


def _land(spark, folder, steps):
    spark.createDataFrame(_rows(steps), TXN_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _same(got, want):
    key = lambda r: [(v is None, str(v)) for v in r]
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def _full(df, period_hours):
    return {
        "weekly_metrics": mon.weekly_metrics(df, period_hours),
        "weekly_rate_by_type": mon.weekly_rate_by_type(df, period_hours),
        "weekly_threshold": mon.weekly_threshold(df, period_hours),
    }


def test_late_rows_are_counted_batch_by_batch_while_the_query_runs(spark):
    base = scratch_path(spark, "test-late")
    _land(spark, f"{base}/in", [1, 2, 30])
    q = feed.start_feed(stream_transactions(spark, f"{base}/in"), f"{base}/out", f"{base}/c", 24, 24, every="0 seconds", tables=TABLES)
    try:
        for steps in ([100, 101, 120], [5, 6, 7, 119], [2, 50, 100, None, 121]):  # the last two bring late rows
            q.processAllAvailable()
            _land(spark, f"{base}/in", steps)
        q.processAllAvailable()
    finally:
        q.stop()
    log = [tuple(r) for r in feed.late_log(spark, f"{base}/out").collect()]
    # the horizon is the greatest step of the batches before, less 24; a day is late once its last step is at or below it
    assert log == [(0, 3, 0, 0, 30, None), (1, 3, 0, 0, 120, 6), (2, 4, 3, 0, 119, 96), (3, 5, 2, 1, 121, 96)]
    side = feed.late_rows(spark, f"{base}/out")
    assert sorted((r.batch, r.step, r.period) for r in side.collect()) == [(2, 5, 0), (2, 6, 0), (2, 7, 0), (3, 2, 0), (3, 50, 2)]
    everything = spark.read.schema(TXN_SCHEMA).parquet(f"{base}/in")
    tables = feed.feed_tables(spark, f"{base}/out", 24, tables=TABLES)
    for name, want in _full(everything, 24).items():
        _same(tables[name], want)
    published = versions.read_current(spark, f"{base}/out", "weekly_metrics")
    assert [(r.period, r.total_transactions) for r in published.orderBy("period").collect()] == [(None, 1), (0, 6), (1, 1), (2, 1), (3, 0)]


def test_interleaved_feed_with_repair_equals_the_batch(spark, txn01):
    base = scratch_path(spark, "test-repair")
    txn01.repartition(4, F.xxhash64("nameOrig", "amount")).write.parquet(f"{base}/in")  # every file holds every week
    stream = stream_transactions(spark, f"{base}/in", max_files_per_trigger=1)
    st.run_to_end(feed.start_feed(stream, f"{base}/out", f"{base}/c", available_now=True, tables=TABLES))
    log = feed.late_log(spark, f"{base}/out").collect()
    assert len(log) == 4 and sum(r.rows for r in log) == txn01.count() and log[0].late_rows == 0 and all(r.late_rows for r in log[1:])
    assert feed.late_rows(spark, f"{base}/out").select(*TXN_COLUMNS).count() == sum(r.late_rows for r in log)
    tables = feed.feed_tables(spark, f"{base}/out", tables=TABLES)
    for name, want in _full(txn01, 168).items():
        _same(tables[name], want)
        if name != "weekly_rate_by_type":  # what is published covers the closed weeks
            closed = versions.read_current(spark, f"{base}/out", name)
            _same(closed, want.where("period < 4"))
    aside = feed.feed_partials(spark, f"{base}/out", repaired=False).agg(F.sum("rows")).first()[0]
    assert aside == txn01.count() - sum(r.late_rows for r in log)


def test_a_reader_never_fails_while_tables_are_published(spark):
    base = scratch_path(spark, "test-atomic")
    _land(spark, f"{base}/in", [1])
    stream = stream_transactions(spark, f"{base}/in", max_files_per_trigger=1)
    q = feed.start_feed(stream, f"{base}/out", f"{base}/c", 24, 0, every="0 seconds", tables=("weekly_metrics",))
    q.processAllAvailable()
    failed, seen, stop = [], set(), threading.Event()

    def read():
        while not stop.is_set():
            try:
                seen.add(versions.read_current(spark, f"{base}/out", "weekly_metrics").count())
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for day in range(1, 10):
            _land(spark, f"{base}/in", [24 * day + 1])
            q.processAllAvailable()
    finally:
        stop.set()
        reader.join()
        q.stop()
    assert not failed and len(seen) > 1
    assert versions.current(spark, f"{base}/out")["batch"] == 9
    assert len(files.listing(spark, f"{base}/out/versions")) <= versions.KEEP


def test_a_killed_batch_leaves_the_old_version_and_counts_once(spark, monkeypatch):
    base = scratch_path(spark, "test-killed")
    _land(spark, f"{base}/in", [1, 100])

    def run():
        stream = stream_transactions(spark, f"{base}/in", max_files_per_trigger=1)
        return feed.start_feed(stream, f"{base}/out", f"{base}/c", 24, 24, available_now=True, tables=TABLES)

    st.run_to_end(run())
    old = versions.current(spark, f"{base}/out")
    _land(spark, f"{base}/in", [2, 3, 101])
    whole = versions.write_version

    def dies(out, version, tables):
        if "weekly_metrics" in tables:
            raise RuntimeError("lost")
        whole(out, version, tables)

    monkeypatch.setattr(versions, "write_version", dies)
    with pytest.raises(Exception, match="lost"):
        st.run_to_end(run())
    assert versions.current(spark, f"{base}/out") == old
    assert versions.read_current(spark, f"{base}/out", "weekly_metrics").count() > 0
    monkeypatch.setattr(versions, "write_version", whole)

    def late_switch(*args, **kwargs):  # dies after the switch, before the stream knows that the batch is done
        switch(*args, **kwargs)
        raise RuntimeError("lost")

    switch = versions.switch
    monkeypatch.setattr(versions, "switch", late_switch)
    with pytest.raises(Exception, match="lost"):
        st.run_to_end(run())
    monkeypatch.setattr(versions, "switch", switch)
    st.run_to_end(run())
    assert [(r.batch, r.rows, r.late_rows) for r in feed.late_log(spark, f"{base}/out").collect()] == [(0, 2, 0), (1, 3, 2)]
    assert feed.feed_partials(spark, f"{base}/out").agg(F.sum("rows")).first()[0] == 5


def test_watch_keeps_account_of_a_running_query(spark):
    base = scratch_path(spark, "test-watch")
    listener = watch.DropWatch(spark, f"{base}/drops")
    spark.streams.addListener(listener)
    _land(spark, f"{base}/in", [1, 200])
    stream = stream_transactions(spark, f"{base}/in", max_files_per_trigger=1)
    writer = st.window_partials(stream, 24, "1 hour").writeStream.format("parquet").outputMode("append")
    q = writer.option("checkpointLocation", f"{base}/c").trigger(processingTime="0 seconds").start(f"{base}/d")
    try:
        for steps in ([201, 202], [3, 4, 203], [5, None, 204]):
            q.processAllAvailable()
            _land(spark, f"{base}/in", steps)
        q.processAllAvailable()
        end = time.monotonic() + 30
        while watch.drops(spark, f"{base}/drops").agg(F.sum("rows_without_step")).first()[0] != 1 and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    got = watch.drops(spark, f"{base}/drops").collect()
    assert [r.dropped_groups > 0 for r in got] == [True, True]
    assert [r.rows_without_step for r in got] == [0, 1] and got[0].batch < got[1].batch


def test_a_new_week_reads_one_folder(spark, txn01):
    base = scratch_path(spark, "test-store")
    landed, store = f"{base}/landed", f"{base}/store"
    land_by_period(txn01.where("step <= 672"), landed)
    first = period_store.refresh(spark, landed, store)
    assert len(first.changed) == 4
    assert period_store.refresh(spark, landed, store).changed == []
    land_by_period(txn01.where("step > 672"), landed, mode="append")
    second = period_store.refresh(spark, landed, store)
    assert second.changed == ["period=4"] and all("/period=4/" in f for f in second.files_read) and second.files_read
    tables = period_store.store_tables(spark, store)
    for name, want in _full(txn01, 168).items():
        _same(tables[name], want)

    late = spark.createDataFrame(_rows([10, 11, None]), TXN_SCHEMA)  # rows added to an old week, and some without a step
    land_by_period(late, landed, mode="append")
    assert period_store.refresh(spark, landed, store).changed == ["period=0", "period=__HIVE_DEFAULT_PARTITION__"]
    tables = period_store.store_tables(spark, store, tables=("weekly_metrics",))
    _same(tables["weekly_metrics"], mon.weekly_metrics(txn01.unionByName(late)))

    rules = mon.monitor_rules(th.RULE_A)
    assert len(period_store.refresh(spark, landed, store, rules=rules).changed) == 6
    _same(
        period_store.store_tables(spark, store, tables=("weekly_threshold",), rules=rules)["weekly_threshold"],
        mon.weekly_threshold(txn01.unionByName(late), rule=th.RULE_A),
    )
    files.remove_folder(spark, f"{landed}/period=0")
    assert period_store.refresh(spark, landed, store, rules=rules).removed == ["period=0"]
    with pytest.raises(ValueError, match="24 hours"):
        period_store.refresh(spark, landed, f"{base}/other", 24)


def test_an_export_is_one_file_and_a_failed_one_leaves_the_old(spark):
    path = f"{scratch_path(spark, 'test-file')}/page.txt"
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, total_value double")
    export(df, path)
    assert files.is_file(spark, path)
    before = files.read_text(spark, path)
    assert before == "k\ttotal_value\na\t1.50\nb\t\n"
    with pytest.raises(Exception, match="no more"):
        export(df.withColumn("k", F.raise_error(F.lit("no more")).cast("string")), path)
    assert files.read_text(spark, path) == before
    export(df.limit(0), path)
    assert files.read_text(spark, path) == "k\ttotal_value\n"
    assert [f[0] for f in files.listing(spark, path.rpartition("/")[0])] == ["page.txt"]
    folder = scratch_path(spark, "test-folder")
    df.write.parquet(folder)
    with pytest.raises(IsADirectoryError):
        export(df, folder)
