"""Data-quality checks (DQ-1..24).

Counts are global aggregates: partial aggregation in every task, one row per
task through the shuffle. ``report`` fuses all of them into ONE scan.
Row-level checks are filters that Catalyst pushes into the Parquet scan;
sampled outputs get a total order so the same rows come back every run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fraudscope.functions.exprs import count_where, fraud, money_digits, money_sum, pct, sort_keys
from fraudscope.functions.measures import ROWS, PartialMeasures, RowMeasures
from fraudscope.schema import BALANCE_COLUMNS, LARGE_AMOUNT, MERCHANT_PREFIX, TXN_COLUMNS
from fraudscope.session import scratch_path


def _is_merchant(col: str = "nameDest") -> Column:
    # LIKE 'M%': NULL name -> NULL (row dropped by a WHERE, and by its negation too)
    return F.col(col).startswith(MERCHANT_PREFIX)


def _rest(df: DataFrame, *first: str) -> list[str]:
    """Columns that break ties: those of the base table in its order, or all of another table."""
    base = TXN_COLUMNS if set(TXN_COLUMNS) <= set(df.columns) else df.columns
    return [c for c in base if c not in first]


def _sorted_rows(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Global sort of row-level output that stays balanced under a hot group.

    Range partitioning sends equal sort keys to one task; identical rows (a
    group of copies holding a third of the table) would all land there. A
    row id as the last key (stable on recompute: same split, same order)
    lets the range partitioner cut such a group across tasks. The id only
    orders otherwise identical rows, so the output is unchanged.
    """
    return df.withColumn("_row_id", F.monotonically_increasing_id()).orderBy(*keys, "_row_id").drop("_row_id")


# ------------------------------------------------------- missing values ----


def missing_value_exprs(columns: Sequence[str] = TXN_COLUMNS) -> list[Column]:
    return [count_where(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]


def missing_values(df: DataFrame, columns: Sequence[str] = TXN_COLUMNS) -> DataFrame:
    """DQ-1: NULL count per column (one row)."""
    return df.agg(*missing_value_exprs(columns))


def merchant_missing(
    df: DataFrame, name: str = "nameDest", balances: Sequence[str] = ("oldbalanceDest", "newbalanceDest")
) -> DataFrame:
    """DQ-2: merchant rows and their missing destination balances."""
    return df.where(_is_merchant(name)).agg(F.count(F.lit(1)).alias("merchant_rows"), *missing_value_exprs(balances))


# ------------------------------------------------------------ duplicates ---


RowHash = Callable[..., Column]


def row_groups(df: DataFrame, columns: Sequence[str] = TXN_COLUMNS) -> DataFrame:
    """Identical rows collapsed to one row with its count (NULL equals NULL).

    One shuffle on the full row; map-side partial aggregation first collapses
    copies inside each task, so even a group of copies holding a third of the
    table sends one row per task through the shuffle.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("duplicate_count"))


def _repeated_rows(df: DataFrame, columns: Sequence[str], row_hash: RowHash) -> tuple[DataFrame, int, int]:
    """(rows whose hash occurs more than once, total rows, rows whose hash occurs once).

    Nearly all rows of a table are distinct, so grouping whole rows sends the
    table through the shuffle. Here only a hash and a count per row go; rows
    with equal values have equal hashes, so a row whose hash occurs once has no
    copy. The hashes that occur more often are written to the shared scratch
    folder and the rows semi-joined on them (Spark broadcasts the hashes only
    below its size limit). Different rows that share a hash are among the rows
    returned, and grouping those by their values tells them apart.
    """
    spark = df.sparkSession
    hashes = df.select(row_hash(*columns).alias("row_hash")).groupBy("row_hash").agg(F.count(F.lit(1)).alias("n"))
    seen = Observation("row-hashes")
    hashes = hashes.observe(
        seen,
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"),
        F.count(F.when(F.col("n") == 1, F.lit(1))).alias("single_rows"),
    )
    path = scratch_path(spark, "repeated-hashes")
    hashes.where(F.col("n") > 1).select("row_hash").write.parquet(path)
    repeated = spark.read.schema("row_hash long").parquet(path)
    rows = df.select(*columns, row_hash(*columns).alias("row_hash")).join(repeated, "row_hash", "left_semi")
    return rows.drop("row_hash"), seen.get["total_rows"], seen.get["single_rows"]


def duplicate_summary(
    df: DataFrame, columns: Sequence[str] = TXN_COLUMNS, row_hash: RowHash = F.xxhash64
) -> DataFrame:
    """DQ-3: total, distinct and surplus rows over the full row (see ``_repeated_rows``; exact)."""
    rows, total, single = _repeated_rows(df, columns, row_hash)
    return (
        row_groups(rows, columns)
        .agg(
            F.lit(total).cast("long").alias("total_rows"),
            (F.count(F.lit(1)) + F.lit(single).cast("long")).alias("distinct_rows"),
        )
        .withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))
    )


def duplicate_groups(
    df: DataFrame, columns: Sequence[str] = TXN_COLUMNS, row_hash: RowHash = F.xxhash64
) -> DataFrame:
    """DQ-4: every repeated row with its count, most repeated first."""
    rows, _, _ = _repeated_rows(df, columns, row_hash)
    return (
        row_groups(rows, columns)
        .where(F.col("duplicate_count") > 1)
        .orderBy(F.desc("duplicate_count"), *sort_keys(rest=columns))
    )


def write_duplicates(
    df: DataFrame, path: str, columns: Sequence[str] = TXN_COLUMNS, row_hash: RowHash = F.xxhash64
) -> dict[str, int]:
    """DQ-3 and DQ-4 from one pass over the hashes and one over the rows.

    The repeated groups (DQ-4) are written to ``path`` as Parquet while an
    ``Observation`` on the grouped rows counts them in the same job (DQ-3);
    observed metrics come from successful tasks only, so a retried task is not
    counted twice. Returns the DQ-3 summary.
    """
    rows, total, single = _repeated_rows(df, columns, row_hash)
    obs = Observation("duplicates")
    groups = row_groups(rows, columns).observe(obs, F.count(F.lit(1)).alias("groups"))
    groups.where(F.col("duplicate_count") > 1).write.mode("overwrite").parquet(path)
    distinct = single + obs.get["groups"]
    return {"total_rows": total, "distinct_rows": distinct, "duplicate_rows": total - distinct}


# ------------------------------------------------------------- amounts -----


def invalid_amount_counts(df: DataFrame, amount: str = "amount") -> DataFrame:
    """DQ-5: negative and zero amounts."""
    return df.agg(
        count_where(F.col(amount) < 0).alias("negative_amounts"),
        count_where(F.col(amount) == 0).alias("zero_amounts"),
    )


def invalid_amount_rows(df: DataFrame, ordered: bool = True, amount: str = "amount") -> DataFrame:
    """DQ-6: rows with amount <= 0, ascending (all columns break ties) unless ``ordered`` is false."""
    rows = df.where(F.col(amount) <= 0)
    if not ordered:
        return rows
    return _sorted_rows(rows, [F.asc_nulls_last(amount), *sort_keys(rest=_rest(df, amount))])


def amount_stat_exprs(amount: str = "amount") -> list[Column]:
    return [
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        # exact decimal sum / count: independent of row order, equal in every engine
        F.round(F.try_divide(money_sum(amount).cast("double"), F.count(amount).cast("double")), 4).alias(
            "avg_amount"
        ),
    ]


def money_issue_exprs(columns: Sequence[str] = ("amount",)) -> list[Column]:
    """Values that an exact sum cannot hold: not finite (left out of the sum) or finer than its scale (rounded)."""
    out = []
    for c in columns:
        no_number = F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
        out.append(count_where(no_number).alias(f"not_finite_{c}"))
        out.append(count_where(F.round(F.col(c), money_digits()) != F.col(c)).alias(f"finer_{c}"))
    return out


def require_exact_money(df: DataFrame, columns: Sequence[str] = ("amount",)) -> None:
    """Raise if a money total would not be exact: NaN, infinite, or finer than the scale (``money_scale``)."""
    found = {k: n for k, n in df.agg(*money_issue_exprs(columns)).first().asDict().items() if n}
    if found:
        raise ValueError(f"money sums with {money_digits()} decimals are not exact: {found}")


def amount_stats(df: DataFrame, amount: str = "amount") -> DataFrame:
    """DQ-7: min, max and mean amount (mean rounded to 4 digits)."""
    return df.agg(*amount_stat_exprs(amount))


def top_amounts(df: DataFrame, n: int = 20, amount: str = "amount") -> DataFrame:
    """DQ-8: the ``n`` largest transactions (TakeOrderedAndProject)."""
    return df.orderBy(F.desc_nulls_last(amount), *sort_keys(rest=_rest(df, amount))).limit(n)


# ------------------------------------------------------------ balances -----


def origin_mismatch(amount: str = "amount", before: str = "oldbalanceOrg", after: str = "newbalanceOrig") -> Column:
    """before - amount <> after, both rounded to cents; NULL operands -> NULL."""
    return F.round(F.col(before) - F.col(amount), 2) != F.round(F.col(after), 2)


def dest_mismatch(
    amount: str = "amount", before: str = "oldbalanceDest", after: str = "newbalanceDest", name: str = "nameDest"
) -> Column:
    """before + amount <> after on non-merchant destinations."""
    return ~_is_merchant(name) & (F.round(F.col(before) + F.col(amount), 2) != F.round(F.col(after), 2))


def _restricted(df: DataFrame, where: Column | str | None) -> DataFrame:
    return df if where is None else df.where(where)


def origin_mismatch_count(df: DataFrame, where: Column | str | None = None, **names: str) -> DataFrame:
    """DQ-9; ``where`` restricts the rows checked (a step range, some types), ``names`` as in ``origin_mismatch``."""
    return _restricted(df, where).where(origin_mismatch(**names)).agg(F.count(F.lit(1)).alias("inconsistent_origin_balance"))


def _sample(rows: DataFrame, n: int, ordered: bool) -> DataFrame:
    """``n`` rows: the first under a total order (reads everything), or any (stops early)."""
    return (rows.orderBy(*sort_keys(rest=_rest(rows))) if ordered else rows).limit(n)


def origin_mismatch_rows(
    df: DataFrame, n: int = 50, ordered: bool = True, where: Column | str | None = None, **names: str
) -> DataFrame:
    """DQ-10: a sample of ``n`` such rows, under a total order unless ``ordered`` is false."""
    return _sample(_restricted(df, where).where(origin_mismatch(**names)), n, ordered)


def dest_mismatch_count(df: DataFrame, where: Column | str | None = None, **names: str) -> DataFrame:
    """DQ-11; ``names`` as in ``dest_mismatch``."""
    return _restricted(df, where).where(dest_mismatch(**names)).agg(F.count(F.lit(1)).alias("inconsistent_dest_balance"))


def dest_mismatch_rows(
    df: DataFrame, n: int = 50, ordered: bool = True, where: Column | str | None = None, **names: str
) -> DataFrame:
    """DQ-12."""
    return _sample(_restricted(df, where).where(dest_mismatch(**names)), n, ordered)


def negative_balance_exprs(columns: Sequence[str] = BALANCE_COLUMNS) -> list[Column]:
    return [count_where(F.col(c) < 0).alias(f"neg_{c}") for c in columns]


def negative_balances(df: DataFrame, columns: Sequence[str] = BALANCE_COLUMNS) -> DataFrame:
    """DQ-13: negatives in each balance column (one pass)."""
    return df.agg(*negative_balance_exprs(columns))


# -------------------------------------------------------------- labels -----


def fraud_distribution(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """DQ-14: rows and share per label value (window over <= 3 aggregated rows)."""
    per_label = df.groupBy(label).agg(F.count(F.lit(1)).alias("transactions"))
    return per_label.withColumn(
        "pct_of_total", pct("transactions", F.sum("transactions").over(Window.partitionBy()), 4)
    )


def type_by_label(df: DataFrame, type_col: str = "type", label: str = "isFraud") -> DataFrame:
    """DQ-15: rows per (type, label)."""
    return (
        df.groupBy(type_col, label)
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy(F.asc_nulls_last(type_col), F.asc_nulls_last(label))
    )


# ------------------------------------------------------------ outliers -----


def outlier_cutoff(
    df: DataFrame, k: float = 3.0, m: RowMeasures | PartialMeasures = ROWS, amount: str = "amount"
) -> DataFrame:
    """One row: amount_rows, mean_amount, stddev_amount (sample) and cutoff = mean + k * deviation.

    From three exact sums (count, sum and sum of squares as decimals), so the result is the
    same however the rows are dealt, and with ``m=PARTIALS`` it comes from any rollup
    built with ``powers=True``, without another look at the rows. The squares are
    first moved, still exactly, to a whole number near the mean; what is then left for
    floating point has no cancellation. NULL where there are fewer than two amounts.
    """
    sums = df.agg(*m.powers(amount))
    near = "CAST(ROUND(CAST(amount_sum AS DOUBLE) / amount_rows) AS DECIMAL(19,0))"
    rows = "CAST(amount_rows AS DECIMAL(19,0))"
    moved = sums.where("amount_rows > 0").selectExpr("*", f"{near} AS c")
    moved = moved.selectExpr(
        "amount_rows AS n", "c", f"amount_sum - {rows} * c AS s1", f"amount_squares - 2 * c * amount_sum + {rows} * c * c AS s2"
    ).selectExpr("n", "CAST(c AS DOUBLE) + CAST(s1 AS DOUBLE) / n AS mean", "CAST(s1 AS DOUBLE) AS s1", "CAST(s2 AS DOUBLE) AS s2")
    deviation = "CASE WHEN n > 1 THEN SQRT(GREATEST(s2 - s1 * s1 / n, 0D) / (n - 1)) END"
    found = moved.selectExpr("n AS amount_rows", "mean AS mean_amount", f"{deviation} AS stddev_amount")
    return found.withColumn("cutoff", F.col("mean_amount") + F.lit(float(k)) * F.col("stddev_amount"))


def amount_outliers(
    df: DataFrame, k: float = 3.0, ordered: bool = True, cutoff: DataFrame | None = None, amount: str = "amount"
) -> DataFrame:
    """DQ-17: rows strictly above mean + k * sample stddev, largest first unless ``ordered`` is false.

    The cut-off is an uncorrelated scalar subquery over exact sums, then an ordinary
    filter -- no join. ``cutoff``: an ``outlier_cutoff`` that is there already (of a
    rollup, say); then the rows are read once.
    """
    limit = (outlier_cutoff(df, k, amount=amount) if cutoff is None else cutoff).select("cutoff").scalar()
    rows = df.where(F.col(amount) > limit)
    if not ordered:
        return rows
    return _sorted_rows(
        rows, [F.desc_nulls_last(amount), *sort_keys(rest=_rest(df, amount))]
    )


# ----------------------------------------------------------- rule flag -----


def flagged_rows(df: DataFrame, flag: str = "isFlaggedFraud") -> DataFrame:
    """DQ-18: rows with the dataset's own flag set."""
    return df.where(F.col(flag) == 1)


def flagged_stats(df: DataFrame, flag: str = "isFlaggedFraud", amount: str = "amount") -> DataFrame:
    """DQ-19."""
    return flagged_rows(df, flag).agg(
        F.count(F.lit(1)).alias("flagged_rows"),
        F.min(amount).alias("min_flagged_amount"),
        F.max(amount).alias("max_flagged_amount"),
    )


def flagged_by_type(df: DataFrame, flag: str = "isFlaggedFraud", type_col: str = "type") -> DataFrame:
    """DQ-20."""
    return flagged_rows(df, flag).groupBy(type_col).agg(F.count(F.lit(1)).alias("flagged_count"))


def unflagged_large(amount: str = "amount", type_col: str = "type", flag: str = "isFlaggedFraud") -> Column:
    """A transfer above the cut-off that the flag missed."""
    return (F.col(type_col) == "TRANSFER") & (F.col(amount) > LARGE_AMOUNT) & (F.col(flag) == 0)


def unflagged_large_transfers(df: DataFrame, **names: str) -> DataFrame:
    """DQ-21: transfers above the cut-off that the flag missed (``names`` as in ``unflagged_large``)."""
    return df.where(unflagged_large(**names))


def unflagged_fraud_transfers(df: DataFrame, label: str = "isFraud", **names: str) -> DataFrame:
    """DQ-22: the same, labelled fraud."""
    return df.where(unflagged_large(**names) & fraud(label))


def zero_origin_balance(df: DataFrame, n: int = 50, amount: str = "amount", before: str = "oldbalanceOrg") -> DataFrame:
    """DQ-23: positive amounts from an empty origin account, ``n`` largest."""
    return (
        df.where((F.col(amount) > 0) & (F.col(before) == 0))
        .orderBy(F.desc_nulls_last(amount), *sort_keys(rest=_rest(df, amount)))
        .limit(n)
    )


def zero_dest_balance(
    df: DataFrame,
    n: int = 50,
    ordered: bool = True,
    amount: str = "amount",
    before: str = "oldbalanceDest",
    name: str = "nameDest",
) -> DataFrame:
    """DQ-24: positive amounts into an empty non-merchant account; ``n`` rows."""
    rows = df.where((F.col(amount) > 0) & (F.col(before) == 0) & ~_is_merchant(name))
    return _sample(rows, n, ordered)


# ------------------------------------------------------------- fused -------


def report(df: DataFrame) -> DataFrame:
    """All global quality counts in ONE scan and ONE aggregate (one row).

    Fuses DQ-1, 2, 5, 7, 9, 11, 13 and 19, and counts the amounts that an
    exact sum cannot hold: each becomes a conditional
    aggregate over the same rows instead of its own pass.
    """
    merchant = _is_merchant()
    flagged = F.col("isFlaggedFraud") == 1
    aggs = (
        [F.count(F.lit(1)).alias("total_rows")]
        + missing_value_exprs()
        + [
            count_where(merchant).alias("merchant_rows"),
            # as DQ-2: NULL when there is no merchant row at all
            F.sum(F.when(merchant, F.col("oldbalanceDest").isNull().cast("long"))).alias(
                "merchant_missing_oldbalanceDest"
            ),
            F.sum(F.when(merchant, F.col("newbalanceDest").isNull().cast("long"))).alias(
                "merchant_missing_newbalanceDest"
            ),
            count_where(F.col("amount") < 0).alias("negative_amounts"),
            count_where(F.col("amount") == 0).alias("zero_amounts"),
        ]
        + amount_stat_exprs()
        + money_issue_exprs()
        + [
            F.count(F.when(origin_mismatch(), F.lit(1))).alias("inconsistent_origin_balance"),
            F.count(F.when(dest_mismatch(), F.lit(1))).alias("inconsistent_dest_balance"),
        ]
        + negative_balance_exprs()
        + [
            F.count(F.when(flagged, F.lit(1))).alias("flagged_rows"),
            F.min(F.when(flagged, F.col("amount"))).alias("min_flagged_amount"),
            F.max(F.when(flagged, F.col("amount"))).alias("max_flagged_amount"),
        ]
    )
    return df.agg(*aggs)
