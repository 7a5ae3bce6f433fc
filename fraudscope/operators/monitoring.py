"""Weekly monitoring metrics (MON-1..10) and alerts (AL-1..6).

Periods are ``floor((step - 1) / period_hours)`` (step 1 = first hour), so the
default ``period_hours=168`` gives calendar weeks. Each metric table starts
from one rollup of additive measures per period (and type / amount band):
one scan with partial aggregation map-side, checkpointed. A spine of every
period between the first and the last one is then left-joined, so a quiet
week shows zeros instead of disappearing. Rows without a step have a row of
their own, with a NULL period, in the metric tables (so totals add up to the
whole table's); alerts leave it out. Spines come from the checkpointed
rollup with ``explode(sequence(lo, hi))``: no cross join, no second scan.
The same final projections read streaming window partials (``*_from_rollup``).

Alerts run on the metric tables: one row per period (per type), so their
windows without a partition key see a few hundred rows at most. Thresholds
are compared in exact integer / decimal arithmetic (rates in units of 1e-4 %,
money as decimals), so a rate sitting exactly on the uplift boundary gives
the same answer in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudscope.functions.bands import AMOUNT_BAND
from fraudscope.functions.exprs import money_digits, money_type, pct
from fraudscope.functions.measures import PARTIALS, require_rules, rollup
from fraudscope.operators.thresholds import PRIMARY_RULE, WATCHLIST_ONLY, WATCHLIST_RULE, Rule
from fraudscope.schema import HOURS_PER_WEEK
from fraudscope.session import checkpoint_root

# Defaults where the prose names a number ("more than 20% above the prior
# four-week average") or leaves it open ("rises sharply", "very large share").
UPLIFT_PCT = 20
LOOKBACK = 4
CONCENTRATION_PCT = 50

# Rule measures carried by every monitoring rollup by default: r0 = review
# threshold / primary queue, r1 = watchlist (rule C unless already primary).
MONITOR_RULES = (PRIMARY_RULE, WATCHLIST_ONLY)
# More periods than this between the first and the last one mean a corrupt step.
MAX_PERIODS = 1_000_000
Rules = tuple[Rule, Rule]


def monitor_rules(rule: Rule = PRIMARY_RULE, watchlist: Rule | None = None) -> Rules:
    """(review rule, watchlist): by default rule C on what the review rule leaves."""
    return rule, watchlist or Rule("watchlist only", WATCHLIST_RULE.min_amount, WATCHLIST_RULE.types, unless=rule)


def with_period(df: DataFrame, period_hours: int = HOURS_PER_WEEK) -> DataFrame:
    return df.withColumn("period", F.expr(f"(step - 1 - pmod(step - 1, {int(period_hours)})) div {int(period_hours)}"))


def materialize(agg: DataFrame) -> DataFrame:
    """Write a small aggregate once to ``spark.checkpoint.dir`` and cut its lineage.

    Without this, Catalyst plans the spine's min / max / distinct as separate
    scans of the big table; with it, the table is scanned once and every later
    step (spine, join, windows) reads a few hundred checkpointed rows.
    """
    checkpoint_root(agg.sparkSession)
    return agg.checkpoint(eager=True)


def period_rollup(
    df: DataFrame, period_hours: int = HOURS_PER_WEEK, by: tuple[str, ...] = (), rules: Rules = MONITOR_RULES
) -> DataFrame:
    """All monitoring measures per period (and ``by``), scanned once and checkpointed."""
    base = df
    if AMOUNT_BAND.name in by and AMOUNT_BAND.name not in df.columns:
        base = df.withColumn(AMOUNT_BAND.name, AMOUNT_BAND.label())
    return materialize(rollup(with_period(base, period_hours), ["period", *by], rules))


def _spine(agg: DataFrame, by_type: bool = False) -> DataFrame:
    """Every period from the first to the last (per observed type), and a NULL one if there is any."""
    bounds = agg.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    far = F.raise_error(F.lit(f"more than {MAX_PERIODS} periods: is a step corrupt?")).cast("long")
    bounds = bounds.withColumn("hi", F.when(F.col("hi") - F.col("lo") >= MAX_PERIODS, far).otherwise(F.col("hi")))
    if not by_type:
        periods = bounds.select(F.explode(F.sequence("lo", "hi")).alias("period"))
    else:
        every = F.explode(F.sequence(bounds.select("lo").scalar(), bounds.select("hi").scalar())).alias("period")
        periods = agg.select("type").distinct().select("type", every)
    return periods.unionByName(agg.where("period IS NULL").select(*periods.columns))


def _fill(spine: DataFrame, agg: DataFrame, keys: list[str]) -> DataFrame:
    # the spine is derived from ``agg`` itself: alias both sides of the self-join
    s, a = spine.alias("s"), agg.alias("a")
    cond = [F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    return s.join(a, cond, "left").select(
        *[F.col(f"s.{k}").alias(k) for k in keys], *[F.col(f"a.{c}").alias(c) for c in agg.columns if c not in keys]
    )


def _merged(
    partials: DataFrame, keys: list[str], spine: bool, by_type: bool = False, rules: Sequence[Rule] = ()
) -> DataFrame:
    """Merge partials to ``keys``; optionally spine-fill; every measure 0 where absent."""
    require_rules(partials, rules)
    merged = partials.groupBy(*keys).agg(
        PARTIALS.rows().alias("rows"),
        *[getattr(PARTIALS, n)().alias(n) for n in ("fraud_rows", "legit_rows", "fraud_value")],
        PARTIALS.value().alias("value"),
        *[c for i, rule in enumerate(rules) for c in PARTIALS.rule(i, rule)],
    )
    if spine:
        merged = _fill(_spine(merged, by_type), merged, keys)
    zero_money = F.lit(0).cast(money_type())
    fills = {}
    for c in merged.columns:
        if c in keys:
            continue
        is_money = c.endswith("value")
        fills[c] = F.coalesce(F.col(c), zero_money if is_money else F.lit(0).cast("long"))
    return merged.withColumns(fills)


def _start_step(period_hours: int) -> Column:
    return (F.col("period") * F.lit(int(period_hours)) + 1).alias("period_start_step")


def _in_order(df: DataFrame, ordered: bool, *keys: str | Column) -> DataFrame:
    """Sorted for a reader; a table that an alert's window sorts again need not be."""
    return df.orderBy(*keys) if ordered else df


def _periods(df: DataFrame) -> DataFrame:
    """The rows that have a period."""
    return df.where(F.col("period").isNotNull())


def _d(c: str) -> Column:
    return F.col(c).cast("double")


# ------------------------------------------------------------- metrics -----


def metrics_from_rollup(
    partials: DataFrame, period_hours: int = HOURS_PER_WEEK, spine: bool = True, ordered: bool = True
) -> DataFrame:
    """MON-1..5 from monitoring partials at any grain that contains ``period``."""
    m = _merged(partials, ["period"], spine)
    out = m.select(
        "period",
        _start_step(period_hours),
        F.col("rows").alias("total_transactions"),
        _d("value").alias("total_value"),
        F.col("fraud_rows").alias("fraud_count"),
        _d("fraud_value").alias("fraud_value"),
        pct("fraud_rows", "rows", 4).alias("fraud_rate_pct"),
    )
    return _in_order(out, ordered, "period")


def rate_by_type_from_rollup(
    partials: DataFrame, period_hours: int = HOURS_PER_WEEK, spine: bool = True, ordered: bool = True
) -> DataFrame:
    """MON-6 from partials whose grain contains ``period`` and ``type``."""
    m = _merged(partials, ["period", "type"], spine, by_type=True)
    out = m.select(
        "period",
        _start_step(period_hours),
        "type",
        F.col("rows").alias("total_transactions"),
        F.col("fraud_rows").alias("fraud_count"),
        _d("fraud_value").alias("fraud_value"),
        pct("fraud_rows", "rows", 4).alias("fraud_rate_pct"),
    )
    return _in_order(out, ordered, "period", F.asc_nulls_last("type"))


def threshold_from_rollup(
    partials: DataFrame,
    period_hours: int = HOURS_PER_WEEK,
    spine: bool = True,
    ordered: bool = True,
    rules: Rules = MONITOR_RULES,
) -> DataFrame:
    """MON-7..10 from monitoring partials that were built with ``rules``."""
    m = _merged(partials, ["period"], spine, rules=rules)
    out = m.select(
        "period",
        _start_step(period_hours),
        F.col("rows").alias("total_transactions"),
        F.col("r0_flagged_transactions").alias("above_threshold_count"),
        _d("r0_flagged_value").alias("above_threshold_value"),
        F.col("r0_flagged_transactions").alias("review_queue_volume"),
        F.col("r1_flagged_transactions").alias("watchlist_volume"),
        F.col("r0_fraud_captured_count").alias("fraud_captured_count"),
        _d("r0_fraud_captured_value").alias("fraud_captured_value"),
        pct("r0_fraud_captured_count", "fraud_rows", 2).alias("fraud_count_capture_pct"),
        pct(_d("r0_fraud_captured_value"), _d("fraud_value"), 2).alias("fraud_value_capture_pct"),
        F.col("r0_legit_affected_count").alias("legit_affected_count"),
        _d("r0_legit_affected_value").alias("legit_affected_value"),
        pct("r0_legit_affected_count", "legit_rows", 2).alias("legit_count_affected_pct"),
    )
    return _in_order(out, ordered, "period")


def weekly_metrics(df: DataFrame, period_hours: int = HOURS_PER_WEEK, ordered: bool = True) -> DataFrame:
    """MON-1..5: volume, value, fraud count / value / rate per period."""
    return metrics_from_rollup(period_rollup(df, period_hours), period_hours, ordered=ordered)


def weekly_rate_by_type(df: DataFrame, period_hours: int = HOURS_PER_WEEK, ordered: bool = True) -> DataFrame:
    """MON-6: fraud rate per period and type; every (period, type) present."""
    return rate_by_type_from_rollup(period_rollup(df, period_hours, by=("type",)), period_hours, ordered=ordered)


def weekly_threshold(
    df: DataFrame,
    period_hours: int = HOURS_PER_WEEK,
    rule: Rule = PRIMARY_RULE,
    watchlist: Rule | None = None,
    ordered: bool = True,
) -> DataFrame:
    """MON-7..10: the review rule week by week (``watchlist``: see ``monitor_rules``).

    Above-threshold count and value, review queue volume (primary queue) and
    the watchlist volume next to it, fraud captured (count, value, % of the
    week's fraud) and legitimate transactions affected (count, value, % of the
    week's legitimate transactions).
    """
    rules = monitor_rules(rule, watchlist)
    partials = period_rollup(df, period_hours, rules=rules)
    return threshold_from_rollup(partials, period_hours, ordered=ordered, rules=rules)


# -------------------------------------------------------------- alerts -----


def _rate_units(rate: str | Column) -> Column:
    """A 4-digit percentage as an exact integer (units of 1e-4 %)."""
    c = F.col(rate) if isinstance(rate, str) else rate
    return F.round(c * F.lit(10000.0)).cast("long")


def _prior(w_partition: list[str], lookback: int) -> Window:
    return Window.partitionBy(*w_partition).orderBy("period").rangeBetween(-lookback, -1)


def _spike(now: Column, prior_sum: Column, prior_n: Column, lookback: int, uplift_pct: int) -> Column:
    """now > (1 + uplift) * mean(prior), in integers; false without a full baseline."""
    full = prior_n == lookback
    return F.coalesce(
        full & (now * F.lit(100 * lookback) > prior_sum * F.lit(100 + uplift_pct)), F.lit(False)
    )


def fraud_rate_spike(metrics: DataFrame, lookback: int = LOOKBACK, uplift_pct: int = UPLIFT_PCT) -> DataFrame:
    """AL-1: weekly fraud rate more than ``uplift_pct`` % above the prior ``lookback``-week mean.

    ``metrics`` is the ``weekly_metrics`` table. The baseline is the plain mean
    of the prior weekly rates and exists only when all ``lookback`` calendar
    periods before have a rate.
    """
    w = _prior([], lookback)
    units = _rate_units("fraud_rate_pct")
    m = _periods(metrics).withColumn("_u", units)
    prior_sum = F.sum("_u").over(w)
    prior_n = F.count("_u").over(w)
    return m.select(
        "period",
        "fraud_rate_pct",
        F.when(prior_n == lookback, F.round(prior_sum / F.lit(lookback * 10000.0), 6)).alias("baseline_rate_pct"),
        _spike(F.col("_u"), prior_sum, prior_n, lookback, uplift_pct).alias("alert"),
    ).orderBy("period")


def type_spike(
    rate_by_type: DataFrame, txn_type: str = "TRANSFER", lookback: int = LOOKBACK, uplift_pct: int = UPLIFT_PCT
) -> DataFrame:
    """AL-2: a type's fraud rate OR fraud count above ``1 + uplift`` x its prior mean."""
    w = _prior(["type"], lookback)
    m = _periods(rate_by_type).where(F.col("type") == txn_type).withColumn("_u", _rate_units("fraud_rate_pct"))
    rate_sum, rate_n = F.sum("_u").over(w), F.count("_u").over(w)
    cnt_sum, cnt_n = F.sum("fraud_count").over(w), F.count("fraud_count").over(w)
    return m.select(
        "period",
        "type",
        "fraud_count",
        "fraud_rate_pct",
        F.when(cnt_n == lookback, cnt_sum / F.lit(float(lookback))).alias("baseline_fraud_count"),
        F.when(rate_n == lookback, F.round(rate_sum / F.lit(lookback * 10000.0), 6)).alias("baseline_rate_pct"),
        (
            _spike(F.col("_u"), rate_sum, rate_n, lookback, uplift_pct)
            | _spike(F.col("fraud_count"), cnt_sum, cnt_n, lookback, uplift_pct)
        ).alias("alert"),
    ).orderBy("period")


def week_over_week(rate_by_type: DataFrame, txn_type: str = "CASH_OUT", uplift_pct: int = UPLIFT_PCT) -> DataFrame:
    """AL-3: a type's fraud count OR value more than ``uplift_pct`` % above last period."""
    w = Window.partitionBy("type").orderBy("period")
    # back to an exact decimal (the double holds a sum of money exactly enough to round-trip)
    m = _periods(rate_by_type).where(F.col("type") == txn_type).withColumn("_v", F.col("fraud_value").cast(f"decimal(38,{money_digits()})"))
    prev_n, prev_v = F.lag("fraud_count").over(w), F.lag("_v").over(w)
    m = m.select("period", "type", "fraud_count", "fraud_value", "_v", prev_n.alias("prev_fraud_count"), prev_v.alias("_pv"))
    up = F.lit(100 + uplift_pct)
    alert = F.coalesce(F.col("fraud_count") * 100 > F.col("prev_fraud_count") * up, F.lit(False)) | F.coalesce(
        F.col("_v") * 100 > F.col("_pv") * up, F.lit(False)
    )
    return m.select(
        "period",
        "type",
        "fraud_count",
        "fraud_value",
        "prev_fraud_count",
        F.col("_pv").cast("double").alias("prev_fraud_value"),
        alert.alias("alert"),
    ).orderBy("period")


def review_surge(threshold_metrics: DataFrame, lookback: int = LOOKBACK, uplift_pct: int = UPLIFT_PCT) -> DataFrame:
    """AL-4: above-threshold volume above ``1 + uplift`` x its prior mean."""
    w = _prior([], lookback)
    s, n = F.sum("above_threshold_count").over(w), F.count("above_threshold_count").over(w)
    return _periods(threshold_metrics).select(
        "period",
        "above_threshold_count",
        F.when(n == lookback, s / F.lit(float(lookback))).alias("baseline_count"),
        _spike(F.col("above_threshold_count"), s, n, lookback, uplift_pct).alias("alert"),
    ).orderBy("period")


def concentration_from_rollup(partials: DataFrame, share_pct: int = CONCENTRATION_PCT) -> DataFrame:
    """AL-5 from partials whose grain contains period, type and amount band."""
    seg = _periods(partials).groupBy("period", "type", AMOUNT_BAND.name).agg(PARTIALS.fraud_value().alias("seg_value"))
    by_period = Window.partitionBy("period")
    ranked = seg.withColumns(
        {
            "period_value": F.sum("seg_value").over(by_period),
            "_rn": F.row_number().over(
                by_period.orderBy(
                    F.desc("seg_value"), F.asc_nulls_last("type"), F.asc_nulls_last(AMOUNT_BAND.rank())
                )
            ),
        }
    ).where((F.col("_rn") == 1) & (F.col("period_value") > 0))
    return ranked.select(
        "period",
        F.col("type").alias("top_type"),
        F.col(AMOUNT_BAND.name).alias("top_amount_band"),
        _d("seg_value").alias("top_fraud_value"),
        _d("period_value").alias("period_fraud_value"),
        pct(_d("seg_value"), _d("period_value"), 2).alias("top_share_pct"),
        (F.col("seg_value") * 100 > F.col("period_value") * F.lit(share_pct)).alias("alert"),
    ).orderBy("period")


def value_concentration(
    df: DataFrame, period_hours: int = HOURS_PER_WEEK, share_pct: int = CONCENTRATION_PCT
) -> DataFrame:
    """AL-5: the period's largest type x amount band share of fraud value.

    One row per period with fraud value; alert when the top segment holds
    more than ``share_pct`` % (compared exactly on decimals). The window
    partitions by period over at most (types x bands) rows per period.
    """
    return concentration_from_rollup(period_rollup(df, period_hours, by=("type", AMOUNT_BAND.name)), share_pct)


def capacity_breach(threshold_metrics: DataFrame, capacity: int) -> DataFrame:
    """AL-6: periods whose review queue exceeds the team's capacity."""
    return _periods(threshold_metrics).select(
        "period",
        "review_queue_volume",
        F.lit(int(capacity)).cast("long").alias("capacity"),
        (F.col("review_queue_volume") > capacity).alias("alert"),
    ).orderBy("period")


MONITORING_TABLES = (
    "weekly_metrics",
    "weekly_rate_by_type",
    "weekly_threshold",
    "alert_fraud_rate_spike",
    "alert_transfer_spike",
    "alert_cash_out_spike",
    "alert_review_surge",
    "alert_value_concentration",
    "alert_capacity_breach",
)


def tables_from_partials(
    partials: DataFrame,
    period_hours: int = HOURS_PER_WEEK,
    capacity: int | None = None,
    names: tuple[str, ...] | None = None,
    rules: Rules = MONITOR_RULES,
) -> dict[str, DataFrame]:
    """MON-1..10 and AL-1..6 from monitoring partials (period x type x amount band grain, built with ``rules``).

    ``names`` selects tables (default: all; AL-6 only with a ``capacity``). A
    period table that several selected tables need is checkpointed once.
    """
    wanted = [n for n in (names or MONITORING_TABLES) if n != "alert_capacity_breach" or capacity is not None]
    cache: dict[str, DataFrame] = {}

    def base(name: str) -> DataFrame:
        if name not in cache:
            build = {
                "weekly_metrics": metrics_from_rollup,
                "weekly_rate_by_type": rate_by_type_from_rollup,
                "weekly_threshold": partial(threshold_from_rollup, rules=rules),
            }[name]
            cache[name] = materialize(build(partials, period_hours))
        return cache[name]

    build_alert = {
        "weekly_metrics": lambda: base("weekly_metrics"),
        "weekly_rate_by_type": lambda: base("weekly_rate_by_type"),
        "weekly_threshold": lambda: base("weekly_threshold"),
        "alert_fraud_rate_spike": lambda: fraud_rate_spike(base("weekly_metrics")),
        "alert_transfer_spike": lambda: type_spike(base("weekly_rate_by_type"), "TRANSFER"),
        "alert_cash_out_spike": lambda: week_over_week(base("weekly_rate_by_type"), "CASH_OUT"),
        "alert_review_surge": lambda: review_surge(base("weekly_threshold")),
        "alert_value_concentration": lambda: concentration_from_rollup(partials),
        "alert_capacity_breach": lambda: capacity_breach(base("weekly_threshold"), capacity),
    }
    return {name: build_alert[name]() for name in wanted}
