"""Reading and landing the transaction table (SRC-1..3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope.functions.exprs import sort_keys
from fraudscope.schema import TXN_COLUMNS, TXN_SCHEMA


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet", sep: str = ",") -> DataFrame:
    """Read the base table with a declared schema (no inference pass over the file).

    CSV columns are taken by the names in the header, in any order and among
    others; a missing one raises, and so does a file whose header differs from
    the first one's. CSV is parsed in FAILFAST mode so a malformed row stops the
    job instead of silently turning into NULLs.
    """
    if fmt == "csv":
        reader = spark.read.schema(_header_schema(spark, path, sep)).option("header", True).option("sep", sep)
        return reader.option("enforceSchema", False).option("mode", "FAILFAST").csv(path).select(*TXN_COLUMNS)
    if fmt == "parquet":
        return spark.read.schema(TXN_SCHEMA).parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def _header_schema(spark: SparkSession, path: str, sep: str = ",") -> T.StructType:
    """The header's columns in their order, with the declared types (others as text)."""
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    missing = [c for c in TXN_COLUMNS if c not in names]
    if missing:
        raise ValueError(f"{path}: the CSV header lacks {', '.join(missing)}")
    return T.StructType([TXN_SCHEMA[c] if c in TXN_COLUMNS else T.StructField(c, T.StringType()) for c in names])


def land_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write the table once as Parquet, so later reads are columnar and pruned (``mode="append"``: add to it).

    ``partition_by`` (e.g. a period column) enables partition pruning for
    incremental weekly runs.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def land_by_period(df: DataFrame, path: str, period_hours: int = 168, mode: str = "overwrite") -> None:
    """Land the table partitioned by period, so an incremental run reads one folder.

    ``period = floor((step - 1) / period_hours)``; a filter on ``period`` becomes a
    partition filter (no file of another period is opened). The rows are
    range-partitioned by period and a hash of the row: a task writes few
    periods, and a hot period is split over several tasks.
    """
    period = F.expr(f"(step - 1 - pmod(step - 1, {int(period_hours)})) div {int(period_hours)}")
    spread = F.xxhash64(*[F.col(c) for c in TXN_COLUMNS])
    dealt = df.withColumn("period", period).withColumn("_spread", spread).repartitionByRange("period", "_spread")
    land_parquet(dealt.drop("_spread"), path, ["period"], mode)


def read_periods(spark: SparkSession, path: str, periods: list[int]) -> DataFrame:
    """Read only the given periods of a table landed with ``land_by_period``."""
    return read_transactions(spark, path).where(F.col("period").isin(*periods))


def stream_transactions(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """The same table as a stream of new files landing under ``path``.

    By default all files that are there make one micro-batch. A limit moves the
    watermark between the batches of a backlog: with it, only a feed in time
    order keeps every row (``streaming.run_to_end`` raises if any was dropped).
    CSV columns are taken by the names in the header of the files that are
    there at the start; a file with another header raises.
    """
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.schema(_header_schema(spark, path)).option("header", True).option("enforceSchema", False)
        return reader.option("mode", "FAILFAST").csv(path).select(*TXN_COLUMNS)
    return reader.schema(TXN_SCHEMA).parquet(path)


def preview(df: DataFrame, n: int = 10, ordered: bool = True) -> DataFrame:
    """First ``n`` rows under a total order over all columns (stable across runs), or any ``n``, which stops early."""
    return (df.orderBy(*sort_keys(rest=TXN_COLUMNS)) if ordered else df).limit(n)


def register_views(df: DataFrame, name: str = "transactions") -> None:
    """Name the table and its segmented view for ``spark.sql`` users.

    Registers ``<name>`` (the base table) and ``<name>_segmented`` (base +
    band columns). Views are lazy: Spark inlines them into each query plan.
    """
    from fraudscope.functions.bands import with_bands

    df.createOrReplaceTempView(name)
    with_bands(df).createOrReplaceTempView(f"{name}_segmented")
