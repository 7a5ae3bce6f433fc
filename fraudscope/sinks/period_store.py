"""Monitoring by increments: partials kept per period, recomputed where files changed.

The table lies in a folder per period (``sources.land_by_period``). The store keeps for
each period its partials (period x type x amount band) and a signature of the files they came
from: names, sizes and times of change. ``refresh`` lists the folders, reads only the periods whose
signature differs, and replaces the store's index last, in one step; a refresh that dies
leaves the old index. The monitoring tables are then sums over the small store.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope import files
from fraudscope.functions.bands import AMOUNT_BAND
from fraudscope.functions.measures import rollup
from fraudscope.operators import monitoring as mon
from fraudscope.schema import HOURS_PER_WEEK, TXN_SCHEMA

INDEX = "CURRENT"


@dataclass(frozen=True)
class Refresh:
    changed: list[str]  # folders of periods that were read
    removed: list[str]  # folders that are gone
    files_read: list[str]


def _signatures(spark: SparkSession, landed: str) -> dict[str, str]:
    out = {}
    for name, folder, _, _ in files.listing(spark, landed):
        if folder and name.startswith("period="):
            own = sorted(f for f in files.listing(spark, f"{landed}/{name}") if not f[0].startswith(("_", ".")))
            out[name] = hashlib.sha256(json.dumps(own).encode()).hexdigest()
    return out


def _index(spark: SparkSession, store: str) -> dict:
    text = files.read_text(spark, f"{store}/{INDEX}")
    return {"made_with": None, "periods": {}} if text is None else json.loads(text)


def refresh(
    spark: SparkSession, landed: str, store: str, period_hours: int = HOURS_PER_WEEK, rules: mon.Rules = mon.MONITOR_RULES
) -> Refresh:
    """Bring the store up to date with the table at ``landed`` (landed with the same ``period_hours``).

    Another period length, or other rules, compute everything anew.
    """
    landed, store = landed.rstrip("/"), store.rstrip("/")
    made_with = [period_hours, *[r.identity() for r in rules]]
    index, there = _index(spark, store), _signatures(spark, landed)
    kept = index["periods"] if index["made_with"] == made_with else {}
    changed = sorted(name for name, s in there.items() if kept.get(name, {}).get("signature") != s)
    removed = sorted(set(index["periods"]) - set(there))
    periods, read = {name: p for name, p in kept.items() if name in there}, []
    if changed:
        rows = spark.read.schema(TXN_SCHEMA).parquet(*[f"{landed}/{name}" for name in changed])
        read = rows.inputFiles()
        base = mon.with_period(rows, period_hours).withColumn(AMOUNT_BAND.name, AMOUNT_BAND.label())
        part = f"parts/{uuid.uuid4().hex}"
        rollup(base, ["period", "type", AMOUNT_BAND.name], rules).repartition("period").write.partitionBy("period").parquet(f"{store}/{part}")
        written = {name for name, folder, _, _ in files.listing(spark, f"{store}/{part}") if folder}
        if not written <= set(changed):
            raise ValueError(f"{landed} was not landed with periods of {period_hours} hours: {sorted(written - set(changed))[:3]}")
        periods |= {name: {"signature": there[name], "part": part if name in written else None} for name in changed}
    if changed or removed or index["made_with"] != made_with:
        files.write_text(spark, f"{store}/{INDEX}", json.dumps({"made_with": made_with, "periods": periods}))
    return Refresh(changed, removed, list(read))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Partials of every period (period x type x amount band)."""
    store, by_part = store.rstrip("/"), {}
    for name, p in _index(spark, store)["periods"].items():
        if p["part"] is not None:
            by_part.setdefault(p["part"], []).append(f"{store}/{p['part']}/{name}")
    if not by_part:
        raise FileNotFoundError(f"{store}: the store holds no period; refresh it first")
    frames = [spark.read.option("basePath", f"{store}/{part}").parquet(*paths) for part, paths in sorted(by_part.items())]
    frames = [f.withColumn("period", F.col("period").cast("long")) for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def store_tables(
    spark: SparkSession,
    store: str,
    period_hours: int = HOURS_PER_WEEK,
    capacity: int | None = None,
    tables: tuple[str, ...] | None = None,
    rules: mon.Rules = mon.MONITOR_RULES,
) -> dict[str, DataFrame]:
    """MON-1..10 and AL-1..6 from the store."""
    return mon.tables_from_partials(read_store(spark, store), period_hours, capacity, tables, rules)
