"""Tables published together, in one step.

A version is a folder of tables, ``<out>/versions/<version>/<table>``. The file
``<out>/CURRENT`` names the version that readers see; it is replaced last, by one
rename, so a reader finds the old tables or the new ones, all of one version, and a
job that dies while it writes leaves the old version in place. Every attempt at a batch
has a folder of its own, so a retry never writes where someone reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from fraudscope import files

POINTER = "CURRENT"
#: Versions kept, the current one included: a reader may hold on to one for that many batches.
KEEP = 10


def current(spark: SparkSession, out_dir: str) -> dict | None:
    """What the pointer says: ``version`` and what was published with it; None before the first."""
    text = files.read_text(spark, f"{out_dir.rstrip('/')}/{POINTER}")
    return None if text is None else json.loads(text)


def version_dir(out_dir: str, version: str) -> str:
    return f"{out_dir.rstrip('/')}/versions/{version}"


def new_version(batch_id: int) -> str:
    return f"{batch_id:09d}-{uuid.uuid4().hex[:8]}"


def write_version(out_dir: str, version: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables (small: one file each) into the version's folder; readers do not see them yet."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{version_dir(out_dir, version)}/{name}")


def switch(spark: SparkSession, out_dir: str, version: str, keep: int = KEEP, **also) -> None:
    """Make the version the current one, with ``also`` beside it in the pointer, and remove those beyond ``keep``."""
    out = out_dir.rstrip("/")
    files.write_text(spark, f"{out}/{POINTER}", json.dumps({"version": version, **also}))
    found = sorted((changed, name) for name, folder, _, changed in files.listing(spark, f"{out}/versions") if folder)
    older = [name for _, name in found if name != version]
    for name in older[: max(0, len(older) - (max(2, keep) - 1))]:
        files.remove_folder(spark, version_dir(out, name))


def read_current(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A table of the current version."""
    now = current(spark, out_dir)
    if now is None:
        raise FileNotFoundError(f"{out_dir}: nothing has been published yet")
    return spark.read.parquet(f"{version_dir(out_dir, now['version'])}/{name}")
