"""Streaming jobs over a live transaction feed.

* ST-1 ``start_window_partials``: watermarked event-time windows x type x
  amount band with additive measures only (counts, decimal sums); totals and
  rates are formed when the small result table is read back, so the state
  and the sink stay mergeable. Append mode: a window is written once, when
  the watermark passes its end.
* ST-2 ``start_review_queue``: stateless routing of every transaction.
* ST-3 ``start_alerts``: ``foreachBatch`` appends the newly closed windows
  under their batch id (a retried batch overwrites its own folder instead of
  appending twice), then re-runs the batch alerts over the small period tables and
  publishes all of them in one step (``sinks.versions``).

``streaming.feed`` is a feed of the same tables that takes in late rows, and
``streaming.watch`` keeps account of what a running query drops.

Event time: ``step`` hours after ``EPOCH`` as a TIMESTAMP (a watermark needs
a zoned timestamp; ``timestamp_seconds`` is zone-free). Windows are aligned
so that period boundaries equal the batch ``(step - 1) div period_hours``.
Checkpoints and outputs live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fraudscope.functions.bands import AMOUNT_BAND
from fraudscope.functions.measures import ROWS, measure_exprs
from fraudscope.operators import monitoring as mon
from fraudscope.operators.thresholds import review_queue
from fraudscope.schema import EPOCH, HOURS_PER_WEEK
from fraudscope.sinks import versions

WATERMARK = "1 day"
NO_STEP = "rows_without_step"
EPOCH_SECONDS = int(datetime.fromisoformat(EPOCH).replace(tzinfo=timezone.utc).timestamp())


def event_time(step: str = "step") -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_SECONDS) + (F.col(step) - 1) * F.lit(3600))


def _window(period_hours: int) -> Column:
    length = period_hours * 3600
    offset = EPOCH_SECONDS % length
    return F.window("ts", f"{length} seconds", f"{length} seconds", f"{offset} seconds")


def window_partials(stream: DataFrame, period_hours: int = HOURS_PER_WEEK, watermark: str = WATERMARK) -> DataFrame:
    """Monitoring measures at the window x type x amount band grain.

    The state holds counts and decimal sums only, so the written windows can
    be merged into any coarser table: MON-1..10 and AL-1..5 all read from it.
    Rows without a step are in no window: they are counted as the metric
    ``NO_STEP``, and ``run_to_end`` raises if there are any.
    """
    return (
        stream.observe(NO_STEP, F.count(F.when(F.col("step").isNull(), F.lit(1))).alias("n"))
        .withColumns({"ts": event_time(), AMOUNT_BAND.name: AMOUNT_BAND.label()})
        .withWatermark("ts", watermark)
        .groupBy(_window(period_hours).alias("w"), "type", AMOUNT_BAND.name)
        .agg(*measure_exprs(ROWS, mon.MONITOR_RULES))
        .select(
            ((F.unix_seconds(F.col("w.start")) - F.lit(EPOCH_SECONDS)) / F.lit(period_hours * 3600))
            .cast("long")
            .alias("period"),
            "*",
        )
        .drop("w")
    )


def metrics_from_partials(partials: DataFrame, period_hours: int = HOURS_PER_WEEK) -> DataFrame:
    """Roll written window partials up to the MON-1..5 table (closed periods only, quiet ones included)."""
    return mon.metrics_from_rollup(partials, period_hours, spine=True)


# The state holds (open windows x types x amount bands) rows, independent of
# the feed's volume; Spark fixes the number of state partitions from
# spark.sql.shuffle.partitions at the query's first start (kept in the
# checkpoint), so a batch-sized setting (thousands) would mean thousands of
# nearly empty state stores per micro-batch.
# The default does not depend on the machine that starts the job first.
STATE_PARTITIONS = 8


def _start(writer, spark, state_partitions: int, path: str | None = None) -> StreamingQuery:
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start(path) if path is not None else writer.start()
    finally:
        spark.conf.set(key, before)


def start_window_partials(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    period_hours: int = HOURS_PER_WEEK,
    available_now: bool = False,
    state_partitions: int = STATE_PARTITIONS,
    watermark: str = WATERMARK,
) -> StreamingQuery:
    """ST-1: append closed windows to a Parquet table.

    ``state_partitions``: fixed at the first start.
    ``watermark``: how late a row may arrive (event time) and still be counted.
    Rows later than that are dropped by the stream; replay an out-of-order
    backlog through the batch jobs instead.
    """
    writer = (
        window_partials(stream, period_hours, watermark)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return _start(writer, stream.sparkSession, state_partitions, sink)


def start_review_queue(stream: DataFrame, sink: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """ST-2: route every transaction; Parquet sink partitioned by queue."""
    writer = (
        review_queue(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("review_queue")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink)


def start_alerts(
    stream: DataFrame,
    out_dir: str,
    checkpoint: str,
    period_hours: int = HOURS_PER_WEEK,
    available_now: bool = False,
    state_partitions: int = STATE_PARTITIONS,
    capacity: int | None = None,
    tables: tuple[str, ...] | None = None,
    watermark: str = WATERMARK,
) -> StreamingQuery:
    """ST-3: monitoring tables and alerts (AL-1..6) re-evaluated as periods close.

    ``tables``: which of ``monitoring.MONITORING_TABLES`` to keep current
    (default all; AL-1 always).

    ``out_dir/partials/batch=<id>`` holds each batch's closed windows. The MON and AL
    tables (one row per period) are published as one version per batch:
    ``sinks.versions.read_current(spark, out_dir, name)`` reads them at any time.
    """
    partials_dir = f"{out_dir}/partials"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch_id and batch.isEmpty():  # no period closed; the first batch writes the empty tables
                return
            batch.write.mode("overwrite").parquet(f"{partials_dir}/batch={batch_id}")
        finally:
            batch.unpersist()
        partials = spark.read.parquet(partials_dir).drop("batch")
        names = tuple(dict.fromkeys((*(tables or mon.MONITORING_TABLES), "alert_fraud_rate_spike")))
        version = versions.new_version(batch_id)
        versions.write_version(out_dir, version, mon.tables_from_partials(partials, period_hours, capacity, names))
        versions.switch(spark, out_dir, version, batch=batch_id)

    writer = (
        window_partials(stream, period_hours, watermark)
        .writeStream.outputMode("append")
        .foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return _start(writer, stream.sparkSession, state_partitions)


class LateRowsDropped(RuntimeError):
    """Rows came later than the watermark allows: the written windows are not complete."""


class RowsWithoutStep(RuntimeError):
    """Rows have no step, so no window holds them: the written windows do not add up to the feed."""


def _note_dropped(query: StreamingQuery, dropped: dict[int, int], no_step: dict[int, int]) -> None:
    for progress in query.recentProgress:
        states = progress["stateOperators"]
        dropped[progress["batchId"]] = sum(s.get("numRowsDroppedByWatermark", 0) for s in states)
        observed = progress["observedMetrics"].get(NO_STEP)
        if observed is not None:
            no_step[progress["batchId"]] = max(no_step.get(progress["batchId"], 0), observed["n"])


def run_to_end(query: StreamingQuery, timeout_s: float | None = None) -> None:
    """Wait for an availableNow query; surface its failure, and rows that no window holds.

    There is no time limit unless one is given. The count of dropped rows is of
    the state's input: rows of one window, type and band that a task has
    already summed count once.
    """
    dropped: dict[int, int] = {}
    no_step: dict[int, int] = {}
    end = None if timeout_s is None else time.monotonic() + timeout_s
    while not query.awaitTermination(2):
        _note_dropped(query, dropped, no_step)
        if end is not None and time.monotonic() > end:
            query.stop()
            raise TimeoutError("streaming query did not finish in time")
    _note_dropped(query, dropped, no_step)
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    if sum(no_step.values()):
        raise RowsWithoutStep(f"{sum(no_step.values())} rows have no step and are in no window")
    if sum(dropped.values()):
        raise LateRowsDropped(
            f"{sum(dropped.values())} late groups of rows were dropped (batches {sorted(b for b, n in dropped.items() if n)}); "
            "replay the backlog through the batch jobs or allow a longer watermark"
        )

