"""Candidate review rules: comparison, per-type detail and queue routing (TH-1..7).

``compare`` evaluates any number of rules in ONE scan. Every row falls into one
bucket: its type (of those that some rule names) and how many of the rules'
distinct cut-offs its amount exceeds. The table is aggregated by bucket, with
partial aggregation map-side, so the only shuffle carries a row per bucket and
task; the rules are then evaluated on the buckets, of which there are at most
(types + 1) x (cut-offs + 1). Three rules or three hundred have the same plan.
No join, no union, no re-scan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope.functions.exprs import count_where, fraud, legit, money, money_digits, money_type, pct
from fraudscope.functions.measures import PARTIALS, ROWS, RULE_MEASURES, PartialMeasures, RowMeasures, measure_exprs, require_rules
from fraudscope.schema import (
    LARGE_AMOUNT,
    RULE_NAMES_ANALYSIS,
    RULE_NAMES_DASHBOARD,
    TRANSFER_WATCH_AMOUNT,
)
from fraudscope.session import checkpoint_root


@dataclass(frozen=True)
class Rule:
    """Flag a transaction when ``amount > min_amount`` (and its type is in ``types``).

    ``unless``: never flag what that other rule flags (e.g. a watchlist that
    only holds what the primary queue does not).
    """

    name: str
    min_amount: float
    types: tuple[str, ...] | None = None
    unless: Rule | None = None

    def predicate(self) -> Column:
        p = F.col("amount") > F.lit(self.min_amount)
        if self.types:
            p = F.col("type").isin(*self.types) & p
        if self.unless is not None:
            p = p & ~self.unless.flag()
        return p

    def identity(self) -> str:
        """What the rule flags, whatever it is called."""
        types = sorted(self.types) if self.types else None
        return json.dumps([float(self.min_amount), types, self.unless.identity() if self.unless else None])

    def flag(self) -> Column:
        """Predicate with NULL read as "not flagged" (a WHERE clause drops NULL rows)."""
        return F.coalesce(self.predicate(), F.lit(False))


def _rules(names: Sequence[str]) -> tuple[Rule, Rule, Rule]:
    a, b, c = names
    return (
        Rule(a, LARGE_AMOUNT),
        Rule(b, LARGE_AMOUNT, ("TRANSFER", "CASH_OUT")),
        Rule(c, TRANSFER_WATCH_AMOUNT, ("TRANSFER",)),
    )


RULE_A, RULE_B, RULE_C = _rules(RULE_NAMES_ANALYSIS)
DASHBOARD_RULES = _rules(RULE_NAMES_DASHBOARD)
PRIMARY_RULE = RULE_B  # recommended primary review queue
WATCHLIST_RULE = RULE_C  # secondary watchlist
WATCHLIST_ONLY = Rule("watchlist only", RULE_C.min_amount, RULE_C.types, unless=PRIMARY_RULE)

COMPARE_COLUMNS = [
    "threshold_name",
    "flagged_transactions",
    "flagged_value",
    "fraud_captured_count",
    "fraud_captured_value",
    "fraud_count_capture_pct",
    "fraud_value_capture_pct",
    "legit_affected_count",
    "legit_affected_value",
    "legit_count_affected_pct",
    "legit_value_affected_pct",
    "total_txns_flagged_pct",
    "total_value_flagged_pct",
]


def _dec_amount() -> Column:
    return F.col("amount").cast(money_type())


def base_total_exprs(m: RowMeasures | PartialMeasures = ROWS) -> list[Column]:
    """TH-1 totals as aggregate expressions (all, fraud, legit; count and value)."""
    return [
        m.rows().alias("total_transactions"),
        m.value().cast("double").alias("total_value"),
        m.fraud_rows().alias("total_fraud_count"),
        m.fraud_value().cast("double").alias("total_fraud_value"),
        m.legit_rows().alias("total_legit_count"),
        m.legit_value().cast("double").alias("total_legit_value"),
    ]


def base_totals(df: DataFrame, m: RowMeasures | PartialMeasures = ROWS) -> DataFrame:
    """TH-1: one row of totals."""
    return df.agg(*base_total_exprs(m))


def _with_shares(df: DataFrame) -> DataFrame:
    return df.select(
        "threshold_name",
        "flagged_transactions",
        "flagged_value",
        "fraud_captured_count",
        "fraud_captured_value",
        pct("fraud_captured_count", "total_fraud_count", 2).alias("fraud_count_capture_pct"),
        pct("fraud_captured_value", "total_fraud_value", 2).alias("fraud_value_capture_pct"),
        "legit_affected_count",
        "legit_affected_value",
        pct("legit_affected_count", "total_legit_count", 2).alias("legit_count_affected_pct"),
        pct("legit_affected_value", "total_legit_value", 2).alias("legit_value_affected_pct"),
        pct("flagged_transactions", "total_transactions", 2).alias("total_txns_flagged_pct"),
        pct("flagged_value", "total_value", 2).alias("total_value_flagged_pct"),
    )


def _check_rules(rules: Sequence[Rule]) -> None:
    if not rules:
        raise ValueError("at least one rule is required")
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("rule names must be unique")


def _unpivot_rules(wide: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row holding totals + ``r<i>_<measure>`` columns -> one row per rule."""
    per_rule = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(rule.name).alias("threshold_name"),
                    *[
                        (F.col(f"r{i}_{k}").cast("double") if k.endswith("_value") else F.col(f"r{i}_{k}")).alias(k)
                        for k in RULE_MEASURES
                    ],
                )
                for i, rule in enumerate(rules)
            ]
        )
    ).alias("r")
    totals = [c for c in wide.columns if c.startswith("total_")]
    long = wide.select(*totals, per_rule).select(*totals, "r.*")
    return _with_shares(long).orderBy(F.asc_nulls_last("threshold_name"))


def _with_exceptions(rules: Sequence[Rule]) -> list[Rule]:
    """The rules and those that they defer to, at any depth."""
    out = []
    for rule in rules:
        while rule is not None:
            out.append(rule)
            rule = rule.unless
    return out


def _bucket_sql(cuts: list[float], lo: int, hi: int) -> str:
    """How many of the sorted ``cuts`` an amount exceeds, as a balanced CASE; NULL exceeds none."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    above, below = _bucket_sql(cuts, mid + 1, hi), _bucket_sql(cuts, lo, mid)
    return f"CASE WHEN amount > CAST('{cuts[mid]!r}' AS DOUBLE) THEN {above} ELSE {below} END"


def _flagged_spans(rule: Rule, txn_type: str | None, cuts: dict[float, int]) -> list[tuple[int, int]]:
    """Ranges of bucket numbers that ``rule`` flags among rows of a type (None: any type no rule names).

    ``cuts``: the place of each cut-off among the sorted ones.
    """
    if rule.types and txn_type not in rule.types:
        return []
    spans = [(cuts[float(rule.min_amount)] + 1, len(cuts))]
    for lo, hi in _flagged_spans(rule.unless, txn_type, cuts) if rule.unless else []:
        spans = [(x, y) for a, b in spans for x, y in ((a, min(b, lo - 1)), (max(a, hi + 1), b)) if x <= y]
    return spans


#: Distinct cut-offs up to which one task evaluates the rules on one list of buckets.
MANY_CUTS = 1000
#: Buckets whose running sums one task works out.
CELL = 1024

_RULE_SCHEMA = "array<struct<threshold_name:string,spans:array<struct<t:string,lo:int,hi:int>>>>"
_AS_RULE = dict(zip(RULE_MEASURES, ("rows", "value", "fraud_rows", "fraud_value", "legit_rows", "legit_value")))


def compare(
    df: DataFrame, rules: Sequence[Rule] = DASHBOARD_RULES, m: RowMeasures | PartialMeasures = ROWS
) -> DataFrame:
    """TH-2 / TH-5 / TH-6: fraud captured versus legit affected, one row per rule.

    Ordered by rule name. ONE scan for any number of rules, in one plan: rows
    are aggregated by bucket (see the module), the buckets become one list, and
    each rule adds up those it flags. A rule that flags nothing keeps its row:
    count 0, NULL sums.

    Beyond ``MANY_CUTS`` distinct cut-offs ``compare_many`` answers.

    With ``m=PARTIALS`` ``df`` is a rollup built with the same ``rules`` (others
    raise) and the rules' pre-aggregated columns are merged instead.
    """
    _check_rules(rules)
    if isinstance(m, PartialMeasures):
        require_rules(df, rules)
        aggs = base_total_exprs(m)
        for i, rule in enumerate(rules):
            aggs += m.rule(i, rule)
        return _unpivot_rules(df.agg(*aggs), rules)

    used = _with_exceptions(rules)
    cuts = sorted({float(r.min_amount) for r in used})
    if len(cuts) > MANY_CUTS:
        return compare_many(df, rules)
    place = {c: i for i, c in enumerate(cuts)}
    types = sorted({t for r in used for t in r.types or ()})
    named = F.when(F.col("type").isin(*types), F.col("type")) if types else F.lit(None).cast("string")
    buckets = (
        df.select(named.alias("t"), F.expr(_bucket_sql(cuts, 0, len(cuts))).alias("k"), "amount", "isFraud")
        .groupBy("t", "k")
        .agg(*measure_exprs(ROWS))
    )
    kinds = {f.name: f.dataType for f in buckets.schema.fields}

    def add_up(groups: str, measure: str) -> Column:
        """SQL's sum over the list: NULL where there is nothing to add."""
        kind = kinds[measure]
        kind = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
        values = F.transform(groups, lambda g: g[measure].cast(kind))
        return F.aggregate(values, F.lit(None).cast(kind), lambda a, x: F.coalesce((a + x).cast(kind), a, x))

    totals = {
        "total_transactions": F.coalesce(add_up("g", "rows"), F.lit(0).cast("long")),
        "total_value": add_up("g", "value").cast("double"),
        "total_fraud_count": add_up("g", "fraud_rows"),
        "total_fraud_value": add_up("g", "fraud_value").cast("double"),
        "total_legit_count": add_up("g", "legit_rows"),
        "total_legit_value": add_up("g", "legit_value").cast("double"),
    }
    spec = [
        {
            "threshold_name": r.name,
            "spans": [{"t": t, "lo": lo, "hi": hi} for t in (*types, None) for lo, hi in _flagged_spans(r, t, place)],
        }
        for r in rules
    ]
    # one row: the list of buckets, which the rules bound
    listed = buckets.agg(F.collect_list(F.struct(*buckets.columns)).alias("g"))
    per_rule = listed.select(
        "g", *[c.alias(k) for k, c in totals.items()], F.inline(F.from_json(F.lit(json.dumps(spec)), _RULE_SCHEMA))
    )

    def flagged(g: Column) -> Column:
        return F.exists("spans", lambda s: s["t"].eqNullSafe(g["t"]) & g["k"].between(s["lo"], s["hi"]))

    hits = per_rule.withColumn("hit", F.filter("g", flagged))
    measures = {k: add_up("hit", src) for k, src in _AS_RULE.items()}
    measures["flagged_transactions"] = F.coalesce(measures["flagged_transactions"], F.lit(0).cast("long"))
    out = hits.select(
        "threshold_name", *totals, *[(c.cast("double") if k.endswith("_value") else c).alias(k) for k, c in measures.items()]
    )
    return _with_shares(out).orderBy(F.asc_nulls_last("threshold_name"))


def _bucket_number(df: DataFrame, cuts: list[float]) -> DataFrame:
    """``df`` with ``k``: how many of the sorted cut-offs the amount exceeds (NULL exceeds none).

    A binary search, unrolled into one projection a step: the plan grows with the
    logarithm of the number of cut-offs, which are one constant array.
    """
    listed = F.split(F.lit(",".join(repr(c) for c in cuts)), ",").cast("array<double>")
    df = df.withColumn("k", F.lit(0))
    step = 1 << (len(cuts).bit_length() - 1)
    while step:
        further = F.col("amount") > F.get(listed, F.col("k") + (step - 1))  # NULL beyond the end
        df = df.withColumn("k", F.col("k") + F.when(further, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df


def compare_many(df: DataFrame, rules: Sequence[Rule], cell: int = CELL) -> DataFrame:
    """``compare`` for any number of cut-offs: work in proportion to rules + buckets.

    ONE scan aggregates the rows by type and bucket. Running sums over the buckets, in
    cells of ``cell`` buckets and then over the cells, give every rule's measures as a
    difference: what lies up to the end of a span less what lies before it.
    """
    _check_rules(rules)
    spark, used = df.sparkSession, _with_exceptions(rules)
    cuts = sorted({float(r.min_amount) for r in used})
    place = {c: i for i, c in enumerate(cuts)}
    types = sorted({t for r in used for t in r.types or ()})
    number = F.lit(len(types))  # rows of a type that no rule names
    for i, t in enumerate(types):
        number = F.when(F.col("type") == t, F.lit(i)).otherwise(number)
    buckets = _bucket_number(df.select(number.alias("t"), "amount", "isFraud"), cuts).groupBy("t", "k").agg(*measure_exprs(ROWS))
    checkpoint_root(spark)
    buckets = buckets.checkpoint(eager=True)

    spans = [(r.name, i, lo, hi) for r in rules for i, t in enumerate((*types, None)) for lo, hi in _flagged_spans(r, t, place)]
    spans = spark.createDataFrame(spans, "threshold_name string, t int, lo int, hi int")
    kinds = {m: f"decimal(38,{money_digits()})" if src.endswith("value") else "long" for m, src in _AS_RULE.items()}
    zero = [F.lit(0).cast(kinds[m]).alias(m) for m in _AS_RULE]
    ends = spans.select("t", F.explode(F.array(F.col("lo") - 1, F.col("hi"))).alias("k"), *zero)
    filled = buckets.select("t", "k", *[F.coalesce(F.col(src).cast(kinds[m]), F.lit(0).cast(kinds[m])).alias(m) for m, src in _AS_RULE.items()])
    filled = filled.unionByName(ends).groupBy("t", "k").agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in _AS_RULE])

    cells = F.floor(F.col("k") / F.lit(cell))
    inside = Window.partitionBy("t", "cell").orderBy("k")
    running = filled.withColumn("cell", cells).select("t", "k", "cell", *[F.sum(m).over(inside).cast(kinds[m]).alias(m) for m in _AS_RULE])
    earlier = Window.partitionBy("t").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = filled.groupBy("t", cells.alias("cell")).agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in _AS_RULE])
    whole = whole.select("t", "cell", *[F.coalesce(F.sum(m).over(earlier).cast(kinds[m]), F.lit(0).cast(kinds[m])).alias(f"before_{m}") for m in _AS_RULE])
    prefix = running.join(whole, ["t", "cell"]).select("t", "k", *[(F.col(m) + F.col(f"before_{m}")).cast(kinds[m]).alias(m) for m in _AS_RULE])
    prefix = prefix.checkpoint(eager=True)

    upto = prefix.select("t", F.col("k").alias("hi"), *[F.col(m).alias(f"hi_{m}") for m in _AS_RULE])
    under = prefix.select("t", (F.col("k") + 1).alias("lo"), *[F.col(m).alias(f"lo_{m}") for m in _AS_RULE])
    parts = spans.join(upto, ["t", "hi"]).join(under, ["t", "lo"])
    flagged = parts.groupBy("threshold_name").agg(*[F.sum(F.col(f"hi_{m}") - F.col(f"lo_{m}")).alias(m) for m in _AS_RULE])
    named = spark.createDataFrame([(r.name,) for r in rules], "threshold_name string").join(flagged, "threshold_name", "left")
    some = F.col("flagged_transactions") > 0  # a sum over no rows is NULL
    measures = {m: F.when(some, F.col(m).cast("double" if m.endswith("_value") else "long")) for m in _AS_RULE if m != "flagged_transactions"}
    totals = buckets.agg(*base_total_exprs(PARTIALS))
    named = named.withColumns(measures).withColumn("flagged_transactions", F.coalesce(F.col("flagged_transactions").cast("long"), F.lit(0).cast("long")))
    return _with_shares(named.withColumns({c: totals.select(c).scalar() for c in totals.columns})).orderBy(F.asc_nulls_last("threshold_name"))


def compare_wide(df: DataFrame, rules: Sequence[Rule] = DASHBOARD_RULES) -> DataFrame:
    """The same answer with one aggregate column per rule measure (a cross-check, kept for the bench)."""
    _check_rules(rules)
    aggs = base_total_exprs(ROWS)
    for i, rule in enumerate(rules):
        aggs += ROWS.rule(i, rule)
    return _unpivot_rules(df.agg(*aggs), rules)


def compare_union(df: DataFrame, rules: Sequence[Rule] = DASHBOARD_RULES) -> DataFrame:
    """The same answer as ``compare`` in filter + UNION ALL + one-row join form.

    One scan per rule plus one for the totals; kept to cross-check ``compare``
    and to measure the one-pass plan against it.
    """
    amt = _dec_amount()
    zero = F.lit(0).cast(money_type())
    parts = [
        df.where(rule.predicate()).agg(
            F.lit(rule.name).alias("threshold_name"),
            F.count(F.lit(1)).alias("flagged_transactions"),
            money(amt).alias("flagged_value"),
            count_where(fraud()).alias("fraud_captured_count"),
            money(F.when(fraud(), amt).otherwise(zero)).alias("fraud_captured_value"),
            count_where(legit()).alias("legit_affected_count"),
            money(F.when(legit(), amt).otherwise(zero)).alias("legit_affected_value"),
        )
        for rule in rules
    ]
    unioned = parts[0]
    for p in parts[1:]:
        unioned = unioned.unionByName(p)
    # the one-row totals attach as uncorrelated scalar subqueries (merged into
    # one aggregate by the optimizer), not as a join
    totals = base_totals(df)
    with_totals = unioned.withColumns({c: totals.select(c).scalar() for c in totals.columns})
    return _with_shares(with_totals).orderBy(F.asc_nulls_last("threshold_name"))


def rule_detail(df: DataFrame, rule: Rule) -> DataFrame:
    """TH-3 / TH-4: a rule's flagged rows by type, most fraud captured first."""
    amt = _dec_amount()
    zero = F.lit(0).cast(money_type())
    return (
        df.where(rule.predicate())
        .groupBy("type")
        .agg(
            F.count(F.lit(1)).alias("flagged_transactions"),
            count_where(fraud()).alias("fraud_captured_count"),
            money(F.when(fraud(), amt).otherwise(zero)).alias("fraud_captured_value"),
            count_where(legit()).alias("legit_affected_count"),
        )
        .orderBy(
            F.desc_nulls_last("fraud_captured_count"),
            F.desc_nulls_last("flagged_transactions"),
            F.asc_nulls_last("type"),
        )
    )


def review_queue(df: DataFrame, primary: Rule = PRIMARY_RULE, watchlist: Rule = WATCHLIST_RULE) -> DataFrame:
    """TH-7: route every transaction to ``primary``, ``watchlist`` or ``none``.

    Row-level and stateless (narrow): each input partition is routed where it
    lies. The rules overlap (large transfers match both); primary wins, and both
    booleans are kept so either view can be rebuilt.
    """
    p, w = primary.flag(), watchlist.flag()
    return df.withColumns(
        {
            "primary_flag": p,
            "watchlist_flag": w,
            "review_queue": F.when(p, F.lit("primary")).when(w, F.lit("watchlist")).otherwise(F.lit("none")),
        }
    )
