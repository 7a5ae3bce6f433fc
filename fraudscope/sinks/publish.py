"""Publish every report table of one run from as few scans as possible.

* one scan -> the dashboard rollup (step x type x amount band x balance band,
  dashboard and monitoring rules), checkpointed; the eight dashboard files,
  the weekly monitoring tables and the alerts all derive from it;
* one scan -> the fused quality summary; one scan of row hashes and one of the
  rows whose hash is repeated -> the duplicate groups and their summary;
* row-level tables (review queue, outliers, invalid amounts) -> Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudscope.functions.measures import BASE_MEASURES, RULE_MEASURES
from fraudscope.operators import monitoring as mon
from fraudscope.operators import quality as dq
from fraudscope.operators import thresholds as th
from fraudscope.schema import HOURS_PER_WEEK
from fraudscope.sinks.export import (
    DASHBOARD_FILES,
    dashboard_rollup,
    dashboard_tables,
    export,
    export_parquet,
    export_row_tables,
)


def monitoring_partials(r: DataFrame, period_hours: int = HOURS_PER_WEEK) -> DataFrame:
    """The dashboard rollup re-keyed for monitoring: period instead of step, monitor rules as r0 / r1."""
    first = len(th.DASHBOARD_RULES)
    renamed = [
        F.col(f"r{first + j}_{m}").alias(f"r{j}_{m}") for j in range(len(mon.MONITOR_RULES)) for m in RULE_MEASURES
    ]
    return mon.with_period(r, period_hours).select(
        "period", "type", "amount_band", *BASE_MEASURES, *renamed
    )


def monitoring_tables(
    r: DataFrame,
    period_hours: int = HOURS_PER_WEEK,
    capacity: int | None = None,
    rules: mon.Rules = mon.MONITOR_RULES,
) -> dict[str, DataFrame]:
    """MON-1..10 and AL-1..6 from the dashboard rollup (no further scan)."""
    return mon.tables_from_partials(monitoring_partials(r, period_hours), period_hours, capacity, rules=rules)


def _write_json(spark, record: dict, path: str) -> None:
    """A one-row summary (observed in a job over the data) as a JSON file."""
    spark.createDataFrame([record]).coalesce(1).write.mode("overwrite").json(path)


def publish_all(
    df: DataFrame,
    out_dir: str,
    period_hours: int = HOURS_PER_WEEK,
    capacity: int | None = None,
    rule: th.Rule = th.PRIMARY_RULE,
) -> dict[str, str]:
    """Write dashboards, monitoring (of review ``rule``), alerts, the quality summary and row-level tables."""
    rules = mon.monitor_rules(rule)
    out = out_dir.rstrip("/")
    r = dashboard_rollup(df, th.DASHBOARD_RULES + rules)
    paths: dict[str, str] = {}
    for name, table in dashboard_tables(df, r).items():
        paths[name] = f"{out}/dashboard/{name}"
        export(table, paths[name], DASHBOARD_FILES[name])
    for name, table in monitoring_tables(r, period_hours, capacity, rules).items():
        paths[name] = f"{out}/monitoring/{name}"
        export_parquet(table.coalesce(1), paths[name])  # one row per period
    paths["quality_report"] = f"{out}/quality/report"
    export_parquet(dq.report(df), paths["quality_report"])
    paths["duplicate_groups"] = f"{out}/quality/duplicate_groups"
    summary = dq.write_duplicates(df, paths["duplicate_groups"])
    paths["duplicate_summary"] = f"{out}/quality/duplicate_summary.json"
    _write_json(df.sparkSession, summary, paths["duplicate_summary"])
    for name, path in export_row_tables(df, f"{out}/rows", r).items():
        paths[name] = path
    return paths
