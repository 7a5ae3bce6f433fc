"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope.session import scratch_path

#: The white space that separates words, in every operator and contract here.
SPACE = r"\x20\x09-\x0D"
#: A key is hot from this share of the rows; of a table's keys, which share its rows, at most twice as many are.
HOT_SHARE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage at a table that every executor can reach, so a lost
    executor costs only the tasks that were running on it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of ``text`` (empty for NULL)."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it.

    A lambda's variable is bound to a value; a column of a lower projection
    may be put in place of each of its mentions by the optimiser.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with each run of white space as one space; NULL counts as empty.

    The pattern only touches runs that are not already a single space.
    """
    pattern = rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+"
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, " "), 256))


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined with ``keyed`` on ``key``, the rows of hot keys without a shuffle.

    ``keyed`` has one row for each key, with ``n``: how many rows have the key, here or
    in a table of at most ``2 * n_rows`` rows that holds these. So at most ``2 * HOT_SHARE``
    keys are hot (``n`` over ``n_rows / HOT_SHARE``), whatever the input: their rows of
    ``keyed`` are broadcast. NULL keys meet nothing.
    """
    payload = [c for c in keyed.columns if c not in (key, "n")]
    is_hot = F.col("n") * HOT_SHARE > n_rows
    hot = keyed.filter(is_hot).select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in payload])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    columns = [F.col(c) for c in rows.columns]
    here = met.filter("hot_key IS NOT NULL").select(*columns, *[F.col(f"hot_{c}").alias(c) for c in payload])
    rest = met.filter("hot_key IS NULL").select(*columns).join(keyed.filter(~is_hot).drop("n"), key)
    return here.unionByName(rest.select(*here.columns))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or with underscores before it until no column has that name (in any case)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted


def one_of_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each combination of ``keys``: the least by all columns in turn, NULL before values.

    Columns that cannot be ordered (maps, variants) come last in that order, by their JSON text.
    """
    rows = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    orderable = [F.col(f"`{f.name}`") for f in df.schema if not _unordered(f.dataType)]
    others = [F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema if _unordered(f.dataType)]
    least = F.min_by(rows, F.struct(*orderable, *others)).alias("r")
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(least).select("r.*")


def _unordered(kind: T.DataType) -> bool:
    """Whether Spark cannot order values of this type."""
    if isinstance(kind, T.ArrayType):
        return _unordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_unordered(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))
