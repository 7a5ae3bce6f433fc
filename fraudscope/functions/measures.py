"""Additive measures: one metric definition, computed from rows or from partials.

Every dashboard and monitoring number is built from a few additive measures
(row counts, label sums, exact decimal sums, per-rule conditional sums).
``ROWS`` aggregates them over transaction rows; ``PARTIALS`` merges them over
a pre-aggregated table (a rollup written once, or streaming window state).
Merging keeps the NULL rules of the originals: a sum over only-NULL inputs is
NULL either way, a row count of nothing is 0.

``rollup`` builds such a partial table at any grain; a dashboard then costs
one scan of the base table plus work on a few thousand rolled-up rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudscope.functions.exprs import fraud, legit, money_digits, money_type

BASE_MEASURES = ("rows", "label_sum", "fraud_rows", "legit_rows", "value", "fraud_value", "legit_value")
#: Power sums of the amount, for mean and deviation (see ``quality.outlier_cutoff``).
POWER_MEASURES = ("amount_rows", "amount_sum", "amount_squares")
RULE_MEASURES = (
    "flagged_transactions",
    "flagged_value",
    "fraud_captured_count",
    "fraud_captured_value",
    "legit_affected_count",
    "legit_affected_value",
)


def _amt() -> Column:
    return F.col("amount").cast(money_type())


def _zero() -> Column:
    return F.lit(0).cast(money_type())


def _rule_column(c: Column, i: int, measure: str, rule) -> Column:
    return c.alias(f"r{i}_{measure}", metadata={"rule": rule.identity()})


def require_rules(partials: DataFrame, rules: Sequence) -> None:
    """Raise unless the partials' rule columns were built with these rules, in this order.

    The columns carry the rule as metadata, which checkpoints and Parquet keep;
    where a reader's own schema has dropped it, only the columns are required.
    """
    fields = {f.name: f for f in partials.schema.fields}
    for i, rule in enumerate(rules):
        field = fields.get(f"r{i}_{RULE_MEASURES[0]}")
        carried = None if field is None else field.metadata.get("rule", rule.identity())
        if carried != rule.identity():
            raise ValueError(f"the partials' rule {i} is {carried or 'absent'}, not {rule.name!r} {rule.identity()}")


class RowMeasures:
    """Measures aggregated over transaction rows."""

    def rows(self) -> Column:
        return F.count(F.lit(1))

    def label_sum(self) -> Column:
        """``SUM(isFraud)``: NULL when every label is NULL."""
        return F.sum("isFraud")

    def fraud_rows(self) -> Column:
        """``SUM(CASE WHEN fraud THEN 1 ELSE 0 END)``: 0 in a group, NULL over no rows."""
        return F.sum(F.when(fraud(), F.lit(1)).otherwise(F.lit(0))).cast("long")

    def legit_rows(self) -> Column:
        return F.sum(F.when(legit(), F.lit(1)).otherwise(F.lit(0))).cast("long")

    def value(self) -> Column:
        return F.sum(_amt())

    def fraud_value(self) -> Column:
        return F.sum(F.when(fraud(), _amt()).otherwise(_zero()))

    def legit_value(self) -> Column:
        return F.sum(F.when(legit(), _amt()).otherwise(_zero()))

    def powers(self, amount: str = "amount") -> list[Column]:
        """Count, sum and sum of squares of the amount, as exact decimals."""
        exact = F.col(amount).cast(f"decimal(18,{money_digits()})")
        return [c.alias(n) for c, n in zip((F.count(exact), F.sum(exact), F.sum(exact * exact)), POWER_MEASURES)]

    def rule(self, i: int, rule) -> list[Column]:
        """Metrics of ``rule`` as if aggregated under ``WHERE rule``.

        ``count`` gives 0 for a rule that flags nothing, every ``sum`` NULL. The
        columns carry what the rule flags (see ``require_rules``).
        """
        flag = rule.flag()
        amt = _amt()
        measures = [
            F.count(F.when(flag, F.lit(1))),
            F.sum(F.when(flag, amt)),
            F.sum(F.when(flag, F.when(fraud(), 1).otherwise(0))).cast("long"),
            F.sum(F.when(flag, F.when(fraud(), amt).otherwise(_zero()))),
            F.sum(F.when(flag, F.when(legit(), 1).otherwise(0))).cast("long"),
            F.sum(F.when(flag, F.when(legit(), amt).otherwise(_zero()))),
        ]
        return [_rule_column(c, i, m, rule) for c, m in zip(measures, RULE_MEASURES)]


class PartialMeasures:
    """The same measures merged over a table of partials (sums of sums)."""

    def rows(self) -> Column:
        return F.coalesce(F.sum("rows"), F.lit(0)).cast("long")

    def label_sum(self) -> Column:
        return F.sum("label_sum")

    def fraud_rows(self) -> Column:
        return F.sum("fraud_rows")

    def legit_rows(self) -> Column:
        return F.sum("legit_rows")

    def value(self) -> Column:
        return F.sum("value")

    def fraud_value(self) -> Column:
        return F.sum("fraud_value")

    def legit_value(self) -> Column:
        return F.sum("legit_value")

    def powers(self, amount: str = "amount") -> list[Column]:
        """Sums of the partials' power sums, whose names do not depend on the amount's."""
        rows, *sums = POWER_MEASURES
        return [F.coalesce(F.sum(rows), F.lit(0)).cast("long").alias(rows), *[F.sum(c).alias(c) for c in sums]]

    def rule(self, i: int, rule) -> list[Column]:
        out = []
        for m in RULE_MEASURES:
            c = F.sum(f"r{i}_{m}")
            if m == "flagged_transactions":
                c = F.coalesce(c, F.lit(0)).cast("long")
            out.append(_rule_column(c, i, m, rule))
        return out


ROWS = RowMeasures()
PARTIALS = PartialMeasures()


def measure_exprs(m: RowMeasures | PartialMeasures, rules: Sequence = ()) -> list[Column]:
    exprs = [getattr(m, name)().alias(name) for name in BASE_MEASURES]
    for i, rule in enumerate(rules):
        exprs += m.rule(i, rule)
    return exprs


def rollup(
    df: DataFrame, grain: Sequence[str], rules: Sequence = (), m: RowMeasures | PartialMeasures = ROWS, powers: bool = False
) -> DataFrame:
    """All measures at ``grain`` (rows in, or partials re-merged at a coarser grain); ``powers``: with the power sums."""
    return df.groupBy(*grain).agg(*measure_exprs(m, rules), *(m.powers() if powers else []))
