"""Column expressions shared by every operator (all built-in, JVM-side)."""

from fraudscope.functions.bands import AMOUNT_BAND, BALANCE_BAND, BandSpec, with_bands
from fraudscope.functions.measures import PARTIALS, ROWS, measure_exprs, rollup
from fraudscope.functions.exprs import (
    count_where,
    fraud,
    legit,
    money,
    money_sum,
    pct,
    sort_keys,
)

__all__ = [
    "AMOUNT_BAND",
    "PARTIALS",
    "ROWS",
    "BALANCE_BAND",
    "BandSpec",
    "with_bands",
    "count_where",
    "fraud",
    "legit",
    "measure_exprs",
    "money",
    "money_sum",
    "pct",
    "rollup",
    "sort_keys",
]
