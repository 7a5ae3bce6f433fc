"""Expression helpers: exact money sums, guarded percentages, label tests, sort keys.

Every helper returns a ``Column`` built from ``pyspark.sql.functions`` so that
the whole expression stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudscope.schema import MONEY_DIGITS

_DIGITS: ContextVar[int] = ContextVar("money_digits", default=MONEY_DIGITS)


@contextmanager
def money_scale(digits: int) -> Iterator[None]:
    """Queries built inside the block sum money with ``digits`` decimals (0 to 12) instead of two.

    Sixteen digits are left before the point; a larger amount raises. Finer
    input is rounded row by row: ``quality.require_exact_money`` tells.
    """
    if not 0 <= digits <= 12:
        raise ValueError("money has 0 to 12 decimals")
    token = _DIGITS.set(digits)
    try:
        yield
    finally:
        _DIGITS.reset(token)


def money_digits() -> int:
    return _DIGITS.get()


def money_type() -> str:
    """The decimal type that an amount is cast to before it is summed."""
    return f"decimal({16 + money_digits()},{money_digits()})"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fraud(label: str = "isFraud") -> Column:
    """Row is labelled fraud. NULL label is neither fraud nor legit."""
    return F.col(label) == 1


def legit(label: str = "isFraud") -> Column:
    return F.col(label) == 0


def money_sum(x: str | Column) -> Column:
    """Exact sum as a decimal (by default, the sum of DECIMAL(18,2) is DECIMAL(28,2)).

    Decimal rather than integer cents: a 100 TB table of payments can hold more
    than 9.2e16 currency units, which overflows a LONG count of cents.
    """
    return F.sum(col(x).cast(money_type()))


def money(x: str | Column) -> Column:
    """Exact money total as DOUBLE; independent of row order and partitioning."""
    return money_sum(x).cast("double")


def count_where(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)``: NULL over no rows, else a count."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def pct(num: str | Column, den: str | Column, digits: int) -> Column:
    """``ROUND(100 * num / den, digits)`` as DOUBLE; NULL when den is 0 or NULL."""
    return F.round(
        F.try_divide(col(num).cast("double") * F.lit(100.0), col(den).cast("double")),
        digits,
    )


def sort_keys(
    first: Iterable[Column] = (), rest: Iterable[str] = (), *, descending: Iterable[str] = ()
) -> list[Column]:
    """Total order: given leading keys, then the remaining columns ascending, NULLs last.

    Used wherever a LIMIT needs a deterministic answer under ties.
    """
    desc = set(descending)
    keys = list(first)
    for c in rest:
        keys.append(F.desc_nulls_last(c) if c in desc else F.asc_nulls_last(c))
    return keys
