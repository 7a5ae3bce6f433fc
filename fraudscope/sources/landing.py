"""Landing a CSV with its malformed lines kept aside (SRC-1).

``read_transactions`` stops at the first malformed line. ``land_csv`` reads the file once, writes
the rows that parse as Parquet and the lines that do not beside them, with the file they came
from and a reason, and counts both; ``max_rejects`` bounds what is let through. A landing is a folder
of its own, named by ``<out>/CURRENT`` once it is complete and within the bound.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope import files
from fraudscope.schema import TXN_COLUMNS, TXN_SCHEMA
from fraudscope.sources.tables import _header_schema

LINE, FILE = "_rejected_line", "_rejected_from"


class TooManyRejects(ValueError):
    """More lines were rejected than the bound allows; the earlier landing stays the current one."""


@dataclass(frozen=True)
class Landing:
    path: str
    good_rows: int
    rejected_rows: int


def _reason(schema: T.StructType, sep: str) -> Column:
    """Why a line was rejected: its number of fields, or the first field that is not of its type."""
    line, texts = F.col(LINE), T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    fields = F.size(F.split(line, f"\\Q{sep}\\E", -1))
    parsed = F.from_csv(line, texts.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": sep})
    why = F.lit("malformed line")
    for f in reversed(schema.fields):
        if not isinstance(f.dataType, T.StringType):
            value = parsed[f.name]
            why = F.when(value.isNotNull() & (value != "") & value.try_cast(f.dataType).isNull(), F.lit(f"{f.name} is no {f.dataType.simpleString()}")).otherwise(why)
    short = F.concat(fields.cast("string"), F.lit(f" fields instead of {len(schema)}"))
    return F.when(~line.contains('"') & (fields != len(schema)), short).otherwise(why)


def land_csv(spark: SparkSession, path: str, out: str, sep: str = ",", max_rejects: int | None = None) -> Landing:
    """Read the CSV at ``path`` once and land it at ``out``: good rows and rejected lines.

    Columns are taken by the header's names, as in ``read_transactions``; a missing column, or a
    file with another header, still raises. ``max_rejects``: raise ``TooManyRejects`` beyond it (None: no bound).
    """
    out, header = out.rstrip("/"), _header_schema(spark, path, sep)
    reader = spark.read.schema(header.add(LINE, T.StringType())).option("header", True).option("sep", sep)
    rows = reader.option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", LINE).csv(path)
    bad = F.col(LINE).isNotNull()
    own = T.StructType([f for f in header.fields if f.name != LINE])
    kept = [F.when(~bad, F.col(c)).alias(c) for c in TXN_COLUMNS]
    rows = rows.select(*kept, LINE, F.when(bad, F.col("_metadata.file_path")).alias(FILE), F.when(bad, _reason(own, sep)).alias("reason"), bad.alias("rejected"))
    seen = Observation("landing")
    counted = rows.observe(seen, F.count(F.when(~bad, F.lit(1))).alias("good"), F.count(F.when(bad, F.lit(1))).alias("bad"))
    run = f"landing-{uuid.uuid4().hex}"
    counted.write.partitionBy("rejected").parquet(f"{out}/{run}")
    landing = Landing(f"{out}/{run}", seen.get["good"], seen.get["bad"])
    if max_rejects is not None and landing.rejected_rows > max_rejects:
        raise TooManyRejects(f"{landing.rejected_rows} lines of {path} were rejected, {max_rejects} allowed; they are in {landing.path}/rejected=true")
    files.write_text(spark, f"{out}/CURRENT", run)
    return landing


def _part(spark: SparkSession, out: str, rejected: bool, schema: T.StructType) -> DataFrame:
    out = out.rstrip("/")
    run = files.read_text(spark, f"{out}/CURRENT")
    if run is None:
        raise FileNotFoundError(f"{out}: nothing has been landed yet")
    folder = f"{out}/{run}/rejected={str(rejected).lower()}"
    return spark.read.schema(schema).parquet(folder) if files.exists(spark, folder) else spark.createDataFrame([], schema)


def read_landing(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the current landing."""
    return _part(spark, out, False, TXN_SCHEMA)


def read_rejects(spark: SparkSession, out: str) -> DataFrame:
    """The rejected lines of the current landing: line, file, reason."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (LINE, FILE, "reason")])
    return _part(spark, out, True, schema).select(F.col(LINE).alias("line"), F.col(FILE).alias("file"), "reason")
