"""Mixing sources to target weights by iterative proportional fitting.

The documents' tokens are summed by cell (source, language, topic). Each margin
has target shares; raking multiplies the cells' weights so that one margin
after the other meets its targets, until all do. A document is then kept with a
probability proportional to its cell's factor (raked weight by natural weight),
scaled so that the largest is one: the expected tokens of every margin are in
the target proportions, and no document is repeated.

All in DataFrame expressions. The rakes work on the cells, of which there are
as many as combinations of values; the texts are read once.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudscope.llm.common import SPACE, materialise, table

MARGINS = ("source", "lang", "topic")
#: Registered targets: shares proportional to natural shares to this power (1 keeps them, 0 makes them equal).
TEMPERATURES = {"source": 0.7, "lang": 0.9, "topic": 1.0}
#: Rakes end when every margin is within this relative error, or when it has stopped falling:
#: the best of so many cycles is not lower than the best before them by this share.
TOLERANCE, STALL_CYCLES, STALL_FALL = 1e-6, 10, 1e-3
#: Cells are broadcast to the documents up to this number (about 100 bytes each).
BROADCAST_CELLS = 100_000
SEED = 7


def token_count(text: Column) -> Column:
    """Words of a text: the weight that is mixed. NULL has none."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def topic(text: Column) -> Column:
    """The kind of writing, by plain marks: markup and tables, numbers, lists of short lines, or prose."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)

    def share(chars: str) -> Column:
        return (n - F.length(F.translate(text, chars, ""))) * 100

    return (
        F.when(share("#*$%&|<>{}=") > 3 * n, "markup")
        .when(share("0123456789") > 5 * n, "numbers")
        .when(share("\n") > 3 * n, "lists")
        .otherwise("prose")
    )


def _margins(text: Column) -> list[Column]:
    """Margin columns; NULL is a value of its own, written as an empty string."""
    return [
        F.coalesce(F.col("`source`").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("`lang`").cast("string"), F.lit("")).alias("lang"),
        topic(text).alias("topic"),
    ]


def tempered_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(margin, target) with shares proportional to the natural ones to ``power``."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow("t", F.lit(power)))
    whole = sums.agg(F.sum("p").alias("whole")).first()[0]  # one row
    return sums.select(margin, (F.col("p") / F.lit(whole)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """``cells`` (margins, tokens) with ``weight``: shares of tokens that meet the targets.

    The state is one factor for each value of each margin: a rake divides a
    value's target by its sum of tokens times the other margins' factors. Cells
    of values that have no target get no weight, and targets without tokens are
    left out (the others keep their proportions). If the targets cannot all be
    met, as with contradictory zeros, the error stops falling: the last cycle's
    weights are returned with a warning. ``{margin}_error`` is how far the
    cell's value of that margin stays from its target, relative to it.
    """
    margins = list(targets)
    used = reduce(lambda df, m: df.join(targets[m].select(m), m, "left_semi"), margins, cells.filter("tokens > 0"))
    used = materialise(used, "cells")
    state = {}
    for m in margins:
        held = targets[m].join(used.select(m).distinct(), m, "left_semi")
        whole = held.agg(F.sum("target")).first()[0]  # less than one if targets without tokens are left out
        scaled = held.select(m, (F.col("target") / F.lit(whole or 1.0)).alias("target"), F.lit(1.0).alias("f"))
        state[m] = materialise(scaled, f"factors-{m}")

    def weighted(names: list[str]) -> DataFrame:
        df = used
        for m in names:
            df = df.join(state[m].select(m, F.col("f").alias(f"f_{m}")), m)
        return df.withColumn("w", reduce(lambda a, m: a * F.col(f"f_{m}"), names, F.col("tokens").cast("double")))

    errors: list[float] = []
    while not _settled(errors):
        worst = 0.0
        for m in margins:
            sums = weighted(margins).groupBy(m).agg(F.sum("w").alias("s"))
            moved = state[m].join(sums, m).withColumn("was", F.col("s")).withColumn("f", F.col("f") * F.col("target") / F.col("s"))
            state[m] = materialise(moved.select(m, "target", "f", "was"), f"factors-{m}")
            # one row: how far this margin was from its targets before
            off = F.max(F.abs(F.col("was") - F.col("target")) / F.col("target"))
            worst = max(worst, state[m].agg(off).first()[0] or 0.0)
        errors.append(worst)
    out = materialise(weighted(margins).select(*margins, "tokens", "w"), "raked")
    whole = out.agg(F.sum("w")).first()[0]
    out = out.withColumn("weight", F.col("w") / F.lit(whole or 1.0)).drop("w")
    left = {}
    for m in margins:
        share = out.groupBy(m).agg(F.sum("weight").alias("share")).join(state[m].select(m, "target"), m)
        off = share.select(m, (F.abs(F.col("share") - F.col("target")) / F.col("target")).alias(f"{m}_error"))
        off = materialise(off, f"error-{m}")
        left[m] = off.agg(F.max(f"{m}_error")).first()[0] or 0.0
        out = out.join(off, m)
    if errors[-1] > TOLERANCE:
        warnings.warn(f"mixing targets not met after {len(errors)} cycles; largest relative error by margin: {left}", stacklevel=2)
    return out.select(*margins, "tokens", "weight", *[f"{m}_error" for m in margins])


def _settled(errors: list[float]) -> bool:
    """Whether the cycles' errors have met ``TOLERANCE`` or stopped falling."""
    if not errors or errors[-1] <= TOLERANCE:
        return bool(errors)
    before, last = errors[:-STALL_CYCLES], errors[-STALL_CYCLES:]
    return bool(before) and min(last) > (1 - STALL_FALL) * min(before)


def cell_probabilities(raked: DataFrame) -> DataFrame:
    """(margins, weight, errors, probability): factor of each cell by the largest one."""
    factor = F.col("weight") / F.col("tokens")
    top = raked.agg(F.max(factor)).first()[0]
    return raked.withColumn("probability", factor / F.lit(top or 1.0)).drop("tokens")


def _probabilities(rows: DataFrame, temperatures: dict[str, float]) -> DataFrame:
    cells = materialise(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "cells")
    targets = {m: tempered_targets(cells, m, temperatures[m]) for m in MARGINS}
    return materialise(cell_probabilities(rake(cells.drop("n_docs"), targets)), "probabilities")


def _with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows joined with their cells, which are broadcast if they are few."""
    if cells.count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)
    return rows.join(cells, list(MARGINS), "left")


def _draw(ident: Column, text: Column) -> Column:
    """A number in [0, 1) for each document, the same in every run; repeated rows share it."""
    return F.pmod(F.xxhash64(F.lit(SEED), ident, text), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(docs: DataFrame, temperatures: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, margins, n_tokens, weight (of its cell), probability, sampled, errors.

    ``{margin}_error`` is the relative error that raking left at the row's value
    of that margin: at most ``TOLERANCE`` or so where the targets can be met,
    and NULL where the value has no tokens.

    NULL sources or languages are a value of their own. Documents without words
    weigh nothing in any margin and are sampled with their cell's probability;
    in a cell without any tokens the probability is 0.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), *_margins(text), token_count(text).alias("n_tokens"), _draw(F.col(f"`{id_col}`"), text).alias("draw")
    )
    rows = materialise(rows, "mix-rows")
    out = _with_cells(rows, _probabilities(rows, temperatures or TEMPERATURES))
    probability = F.coalesce("probability", F.lit(0.0))
    return out.select(
        "doc_id", *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), probability.alias("probability"),
        (F.col("draw") < probability).alias("sampled"), *[f"{m}_error" for m in MARGINS],
    )


def sample_mix(docs: DataFrame, temperatures: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`mix` samples, with their columns."""
    text = F.col(f"`{text_col}`")
    sums = materialise(
        docs.select(*_margins(text), token_count(text).alias("n_tokens")).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")), "mix-sums"
    )
    cells = _probabilities(sums, temperatures or TEMPERATURES)
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_margins(text), _draw(F.col(f"`{id_col}`"), text).alias("draw")
    )
    return _with_cells(marked, cells).filter("draw < coalesce(probability, 0)").select("row.*")


def op6_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
