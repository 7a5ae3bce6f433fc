"""Exports (SNK-1..8).

Dashboard tables are small post-aggregate results (at most one row per step
or per segment), so each is written as ONE delimited file with a header, of
exactly the name given: the result is range-sorted and coalesced to one partition,
which keeps the order, written aside and moved to its path when it is whole. Row-level results (review queue, outliers) go to Parquet through
``export_parquet`` and are never funnelled through one task.

Money columns are written as DECIMAL(38,2) text (``1144392944759.77``), not
as Java double text (``1.1443929447597686E12``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope import files
from fraudscope.functions.bands import with_bands
from fraudscope.functions.exprs import money_digits
from fraudscope.functions.measures import PARTIALS, rollup
from fraudscope.operators import segments as seg
from fraudscope.operators import thresholds as th
from fraudscope.session import checkpoint_root

MONEY_SUFFIX = "_value"

# Target file names and separators of the dashboard exports (fixed values).
DASHBOARD_FILES = {
    "executive_summary_dashboard.csv": ";",
    "page1_fraud_trend_by_step.csv": ",",
    "executive_summary_dashboard.txt": "\t",
    "page2_fraud_by_type.txt": "\t",
    "page2_fraud_by_amount_band.txt": "\t",
    "page2_top_risk_segments.txt": "\t",
    "page2_fraud_by_origin_balance_band.txt": "\t",
    "page3_threshold_comparison.txt": "\t",
}


def _money_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if f.name.endswith(MONEY_SUFFIX) and isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]


def _plain_double(c: str):
    """A double in plain notation with at least one decimal (0.0002, 24.7191, 0.0).

    Java writes doubles below 1e-3 as ``2.0E-4``; rates are rounded to at most
    4 digits, so 10 decimals hold them exactly and the text parses back to
    the same double; any other double that does not keeps Java's text.
    """
    x = F.col(c)
    text = F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", "")
    plain = F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    # a double that ten decimals or DECIMAL(38,10)'s range cannot hold (never a rate) keeps Spark's own text
    held = F.when(F.abs(x) < F.lit(1e17), text.cast("double") == x).otherwise(F.lit(False))
    return F.when(held, plain).otherwise(x.cast("string"))


def export(
    df: DataFrame,
    path: str,
    sep: str = "\t",
    money_columns: Sequence[str] | None = None,
    order_by: Sequence | None = None,
) -> None:
    """Write a small result as one headered delimited file at exactly ``path``.

    The file is written in a folder beside it and moved into place by a rename, so a
    write that fails leaves the old file, and a reader never finds half of one.

    With ``order_by`` the rows are sorted in the one partition that is written;
    without, ``df`` comes ordered and is coalesced.

    Money columns as decimal text with the scale of money, other doubles in plain notation.
    NULL is written as an empty field; a value holding the separator is quoted.
    """
    money_cols = set(_money_columns(df) if money_columns is None else money_columns)
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    out = df.select(
        *[
            F.col(c).cast(f"decimal(38,{money_digits()})").alias(c)
            if c in money_cols
            else _plain_double(c).alias(c)
            if c in doubles
            else F.col(c)
            for c in df.columns
        ]
    )
    one = out.coalesce(1) if order_by is None else out.repartition(1).sortWithinPartitions(*order_by)
    aside = files.beside(path)
    spark = df.sparkSession
    try:
        one.write.option("header", True).option("sep", sep).csv(aside)
        part = [n for n, _, _, _ in files.listing(spark, aside) if n.startswith("part-")]
        files.replace_file(spark, f"{aside}/{part[0]}", path)
    finally:
        files.remove_folder(spark, aside)


def export_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Row-level output: every task writes its own files; the driver only commits."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_export(spark: SparkSession, path: str, schema: T.StructType, sep: str = "\t") -> DataFrame:
    """Read an export back with the schema of the frame that produced it."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)  # a header in another order raises
        .option("sep", sep)
        .option("mode", "FAILFAST")
        .csv(path)
    )


DASHBOARD_GRAIN = ["step", "type", "amount_band", "origin_balance_band"]


def dashboard_rollup(df: DataFrame, rules: tuple = th.DASHBOARD_RULES) -> DataFrame:
    """Every measure the eight dashboard files need, at step x type x both bands.

    ONE scan of the transaction table; the result (bounded by steps x types x
    30 band pairs, independent of row count) is checkpointed to
    ``spark.checkpoint.dir``, so the eight exports never touch the base table
    again and an executor lost later does not re-trigger the scan.
    """
    checkpoint_root(df.sparkSession)
    return rollup(with_bands(df), DASHBOARD_GRAIN, rules, powers=True).checkpoint(eager=True)


def dashboard_tables(df: DataFrame, r: DataFrame | None = None) -> dict[str, DataFrame]:
    """The eight dashboard tables, keyed by file name, all from one rollup.

    ``r``: an existing ``dashboard_rollup`` whose first rules are the dashboard rules.
    """
    r = dashboard_rollup(df) if r is None else r
    summary = seg.executive_summary(r, PARTIALS)
    by_type = (
        seg.segment_metrics(r, ["type"], m=PARTIALS)
        .select("type", "total_transactions", "total_value", "fraud_count", "fraud_value", "fraud_rate_pct")
        .orderBy(F.desc_nulls_last("fraud_rate_pct"), F.asc_nulls_last("type"))
    )
    return {
        "executive_summary_dashboard.csv": summary,
        "page1_fraud_trend_by_step.csv": seg.trend_by_step(r, PARTIALS),
        "executive_summary_dashboard.txt": summary,
        "page2_fraud_by_type.txt": by_type,
        "page2_fraud_by_amount_band.txt": seg.by_amount_band(r, PARTIALS),
        "page2_top_risk_segments.txt": seg.top_risk(r, m=PARTIALS),
        "page2_fraud_by_origin_balance_band.txt": seg.by_origin_balance_band(r, PARTIALS),
        "page3_threshold_comparison.txt": th.compare(r, th.DASHBOARD_RULES, PARTIALS),
    }


def export_all(df: DataFrame, out_dir: str) -> dict[str, str]:
    """SNK-1..8: write every dashboard file under ``out_dir``; returns name -> path."""
    paths = {}
    for name, table in dashboard_tables(df).items():
        path = f"{out_dir.rstrip('/')}/{name}"
        export(table, path, DASHBOARD_FILES[name])
        paths[name] = path
    return paths


def export_row_tables(df: DataFrame, out_dir: str, r: DataFrame | None = None) -> dict[str, str]:
    """Row-level results as Parquet: review queue (by queue), outliers, invalid amounts.

    ``r``: an existing ``dashboard_rollup``, which gives the outliers' cut-off without another scan.

    Written by every task in parallel; nothing goes through one partition.
    """
    from fraudscope.operators import quality as dq

    out = out_dir.rstrip("/")
    paths = {
        "review_queue": f"{out}/review_queue",
        "amount_outliers": f"{out}/amount_outliers",
        "invalid_amounts": f"{out}/invalid_amounts",
    }
    export_parquet(th.review_queue(df), paths["review_queue"], ["review_queue"])
    cutoff = None if r is None else dq.outlier_cutoff(r, m=PARTIALS)
    export_parquet(dq.amount_outliers(df, ordered=False, cutoff=cutoff), paths["amount_outliers"])
    export_parquet(dq.invalid_amount_rows(df, ordered=False), paths["invalid_amounts"])
    return paths
