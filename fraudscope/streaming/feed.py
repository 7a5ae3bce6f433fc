"""A monitoring feed that takes in late rows (ST-1, ST-3).

Each micro-batch is aggregated once, to period x type x amount band, and merged into the
previous version's partials: sums of sums, so a row may come in any order and at any time. There
is no state store; the state is the small table of partials in the current version.

A period is closed once the feed has seen a step more than ``delay_hours`` past its end.
Rows that come for a period which an earlier batch has closed are late. They are

* counted exactly, batch by batch (``late_log``),
* kept in a side table (``late_rows``),
* merged into their closed period, which is published again (``repair=False`` leaves them
  out of the published tables; the partials keep them apart, so they can be merged later).

The monitoring tables and alerts of closed periods are published together, in one step
(``sinks.versions``). The horizon that decides what is late comes from the pointer of the
version before the batch, so a retried batch decides alike and counts nothing twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fraudscope import files
from fraudscope.functions.bands import AMOUNT_BAND
from fraudscope.functions.measures import PARTIALS, rollup
from fraudscope.operators import monitoring as mon
from fraudscope.schema import HOURS_PER_WEEK, TXN_COLUMNS, TXN_SCHEMA
from fraudscope.sinks import versions

GRAIN = ["period", "type", AMOUNT_BAND.name, "late"]
DELAY_HOURS = 24

LOG_SCHEMA = "batch long, rows long, late_rows long, rows_without_step long, max_step long, horizon long"


def _closed(horizon: int | None, period_hours: int) -> Column:
    """Whether the period's last step lies at or before the horizon (no horizon: none is closed)."""
    if horizon is None:
        return F.lit(False)
    return F.coalesce((F.col("period") + 1) * F.lit(period_hours) <= F.lit(horizon), F.lit(False))


def _horizon(max_step: int | None, delay_hours: int) -> int | None:
    return None if max_step is None else max_step - delay_hours


def _merge(partials: DataFrame, rules: mon.Rules, grain: list[str]) -> DataFrame:
    return rollup(partials, grain, rules, PARTIALS)


def start_feed(
    stream: DataFrame,
    out_dir: str,
    checkpoint: str,
    period_hours: int = HOURS_PER_WEEK,
    delay_hours: int = DELAY_HOURS,
    available_now: bool = False,
    every: str = "1 minute",
    capacity: int | None = None,
    tables: tuple[str, ...] | None = None,
    repair: bool = True,
    rules: mon.Rules = mon.MONITOR_RULES,
) -> StreamingQuery:
    """Keep the monitoring tables and alerts of ``stream`` current under ``out_dir`` (see the module).

    ``tables``: which of ``monitoring.MONITORING_TABLES`` to publish (default all).
    """
    out = out_dir.rstrip("/")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = versions.current(spark, out)
        if now is not None and now["batch"] > batch_id:
            return  # long published
        before = now if now is None or now["batch"] < batch_id else now["before"]  # a retry starts from what was before it
        had = before["max_step"] if before else None
        late = _closed(_horizon(had, delay_hours), period_hours)
        rows = mon.with_period(batch, period_hours).withColumns({"late": late, AMOUNT_BAND.name: AMOUNT_BAND.label()})

        seen = Observation(f"feed-{batch_id}")
        counted = rows.observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(F.col("late"), F.lit(1))).alias("late_rows"),
            F.count(F.when(F.col("step").isNull(), F.lit(1))).alias("rows_without_step"),
            F.max("step").alias("max_step"),
        )
        version = versions.new_version(batch_id)
        versions.write_version(out, version, {"fresh": rollup(counted, GRAIN, rules)})
        folder = versions.version_dir(out, version)
        found = {k: seen.get[k] for k in ("rows", "late_rows", "rows_without_step", "max_step")}
        if found["late_rows"]:
            own = rows.where("late").select(*TXN_COLUMNS, "period")
            own.write.mode("overwrite").parquet(f"{out}/late_rows/batch={batch_id}")

        steps = [s for s in (had, found["max_step"]) if s is not None]
        top = max(steps) if steps else None
        partials = spark.read.parquet(f"{folder}/fresh")
        if before:
            partials = spark.read.parquet(f"{versions.version_dir(out, before['version'])}/partials").unionByName(partials)
        versions.write_version(out, version, {"partials": _merge(partials, rules, GRAIN)})
        shown = spark.read.parquet(f"{folder}/partials")
        shown = (shown if repair else shown.where(~F.col("late"))).drop("late")
        # a row of any table depends on its own and earlier periods only, so the open ones are cut off last (quiet ones stay)
        closed = _closed(_horizon(top, delay_hours), period_hours) | F.col("period").isNull()
        built = mon.tables_from_partials(shown, period_hours, capacity, tables, rules)
        versions.write_version(out, version, {name: t.where(closed) for name, t in built.items()})

        record = {"batch": batch_id, **found, "horizon": _horizon(had, delay_hours)}
        files.write_text(spark, f"{out}/log/batch={batch_id}.json", json.dumps(record))
        kept = {"version": before["version"], "max_step": had, "batch": before["batch"]} if before else None
        versions.switch(spark, out, version, batch=batch_id, max_step=top, before=kept)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def feed_partials(spark: SparkSession, out_dir: str, repaired: bool = True) -> DataFrame:
    """Partials of all periods the feed has seen, open ones too; ``repaired``: with the late rows."""
    partials = versions.read_current(spark, out_dir, "partials")
    return (partials if repaired else partials.where(~F.col("late"))).drop("late")


def feed_tables(
    spark: SparkSession,
    out_dir: str,
    period_hours: int = HOURS_PER_WEEK,
    capacity: int | None = None,
    tables: tuple[str, ...] | None = None,
    repaired: bool = True,
    rules: mon.Rules = mon.MONITOR_RULES,
) -> dict[str, DataFrame]:
    """MON-1..10 and AL-1..6 of all periods the feed has seen, the open ones as they stand."""
    return mon.tables_from_partials(feed_partials(spark, out_dir, repaired), period_hours, capacity, tables, rules)


def late_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """A row per batch: rows, late ones, those without a step, the greatest step and the horizon that decided."""
    log = f"{out_dir.rstrip('/')}/log"
    if not files.listing(spark, log):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).json(log).orderBy("batch")


def late_rows(spark: SparkSession, out_dir: str) -> DataFrame:
    """The side table: late rows with their period and the batch that brought them."""
    schema = T.StructType([*TXN_SCHEMA.fields, T.StructField("period", T.LongType()), T.StructField("batch", T.LongType())])
    side = f"{out_dir.rstrip('/')}/late_rows"
    if not files.exists(spark, side):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(side)
