"""Band columns: one spec yields both the label and its display rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudscope.schema import (
    AMOUNT_CUTS,
    AMOUNT_LABELS,
    BALANCE_CUTS,
    BALANCE_LABELS,
    BALANCE_ZERO_LABEL,
)


@dataclass(frozen=True)
class BandSpec:
    """Upper-inclusive cuts over ``source``; ``labels`` has one more entry than ``cuts``.

    A value equal to zero goes to ``zero_label`` first when set. A NULL value
    fails every comparison and lands in the last (open) band, like a SQL
    searched CASE with an ELSE branch.
    """

    name: str
    source: str
    cuts: tuple[float, ...]
    labels: tuple[str, ...]
    zero_label: str | None = None

    def __post_init__(self) -> None:
        if len(self.labels) != len(self.cuts) + 1:
            raise ValueError("labels must have exactly one more entry than cuts")

    @property
    def ordered_labels(self) -> tuple[str, ...]:
        return ((self.zero_label,) if self.zero_label is not None else ()) + self.labels

    def label(self) -> Column:
        x = F.col(self.source)
        branches = []
        if self.zero_label is not None:
            branches.append((x == 0, self.zero_label))
        branches += [(x <= cut, lab) for cut, lab in zip(self.cuts, self.labels)]
        expr = F.when(branches[0][0], F.lit(branches[0][1]))
        for cond, lab in branches[1:]:
            expr = expr.when(cond, F.lit(lab))
        return expr.otherwise(F.lit(self.labels[-1]))

    def rank(self, label: str | Column | None = None) -> Column:
        """1-based display rank of a label column (NULL for an unknown label)."""
        lab = F.col(label or self.name) if not isinstance(label, Column) else label
        expr = None
        for i, text in enumerate(self.ordered_labels, start=1):
            expr = F.when(lab == text, F.lit(i)) if expr is None else expr.when(lab == text, F.lit(i))
        return expr


AMOUNT_BAND = BandSpec("amount_band", "amount", AMOUNT_CUTS, AMOUNT_LABELS)
BALANCE_BAND = BandSpec(
    "origin_balance_band", "oldbalanceOrg", BALANCE_CUTS, BALANCE_LABELS, BALANCE_ZERO_LABEL
)


def with_bands(df: DataFrame, specs: tuple[BandSpec, ...] = (AMOUNT_BAND, BALANCE_BAND)) -> DataFrame:
    """Segmented view: base columns + band labels + ``origin_balance_zero_flag``.

    A lazy projection; Catalyst prunes the band columns a query does not use.
    """
    cols = {s.name: s.label() for s in specs}
    cols["origin_balance_zero_flag"] = F.when(F.col("oldbalanceOrg") == 0, F.lit(1)).otherwise(F.lit(0))
    return df.withColumns(cols)
