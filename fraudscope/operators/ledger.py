"""Duplicates across landings (DQ-3, DQ-4 by increments).

The ledger holds, per landing, the SHA-256 of every distinct row with its count, bucketed and
sorted by digest. A new landing is hashed once; whether its rows occurred before is a join of
its digests with the ledger, in which only the new digests are dealt out: the ledger's files already
lie by bucket. Rows of equal digest have equal values (NULL equals NULL, 0.0 equals -0.0, NaN
equals NaN, as in a GROUP BY), so no earlier row is read again.

Of rows that are found repeated, the landing's values are kept beside the ledger; an old row
that a new landing repeats gets its values from the new copy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudscope import files
from fraudscope.functions.exprs import sort_keys
from fraudscope.schema import TXN_SCHEMA
from fraudscope.session import scratch_path

BUCKETS = 64


def _one_zero(f: T.StructField) -> Column:
    """A column in which -0.0 is 0.0, as a GROUP BY has it."""
    value = F.col(f"`{f.name}`")
    floating = isinstance(f.dataType, (T.DoubleType, T.FloatType))
    return ((value + F.lit(0.0)).cast(f.dataType) if floating else value).alias(f.name)


def row_digest(schema: T.StructType) -> Column:
    """SHA-256 of a row: each value as its text with its length before it, NULL as a mark."""

    def field(f: T.StructField) -> Column:
        text = _one_zero(f).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[field(f) for f in schema.fields]), 256))


class RowLedger:
    """A ledger at ``path``, known to the session's catalog as ``name``.

    ``buckets`` is fixed when the ledger is made. Another session attaches to the same path.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, schema: T.StructType = TXN_SCHEMA, buckets: int = BUCKETS):
        self._spark, self._name, self._path, self._schema, self._buckets = spark, name, path.rstrip("/"), schema, buckets
        begun = bool(files.listing(spark, f"{self._path}/rows"))
        if begun:
            found = files.read_text(spark, f"{self._path}/BUCKETS")
            if found != str(buckets):
                raise ValueError(f"{path} was made with {found} buckets")
        else:
            files.write_text(spark, f"{self._path}/BUCKETS", str(buckets))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, n BIGINT, landing STRING) USING parquet PARTITIONED BY (landing) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self._path}/rows'"
        )
        if begun:
            spark.catalog.recoverPartitions(name)

    def landings(self) -> list[str]:
        return sorted(n.partition("=")[2] for n, folder, _, _ in files.listing(self._spark, f"{self._path}/rows") if folder and n.startswith("landing="))

    def digests(self) -> DataFrame:
        """(digest, n, landing); bucketed, so a join or a grouping by digest does not shuffle it."""
        return self._spark.table(self._name)

    def add(self, df: DataFrame, landing: str) -> None:
        """Take in a landing. Its digests are appended last; a landing that is there already raises.

        An attempt that failed before that leaves the ledger as it was, and can be repeated.
        """
        if not landing.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a landing's name has letters, digits, - and _ only")
        if landing in self.landings():
            raise ValueError(f"landing {landing!r} is in the ledger already")
        rows = df.select(*[_one_zero(f) for f in self._schema.fields]).withColumn("digest", row_digest(self._schema))
        counts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        own = scratch_path(self._spark, "landing-digests")
        counts.repartition(self._buckets, "digest").sortWithinPartitions("digest").write.parquet(own)
        counts = self._spark.read.schema("digest binary, n long").parquet(own)
        before = self.digests().select("digest")
        repeated = counts.where("n > 1").select("digest").unionByName(counts.select("digest").join(before, "digest", "left_semi")).distinct()
        groups = rows.join(repeated, "digest", "left_semi").dropDuplicates(["digest"])
        groups.write.mode("overwrite").parquet(f"{self._path}/groups/landing={landing}")
        dealt = counts.repartition(self._buckets, "digest").sortWithinPartitions("digest")
        dealt.select("digest", "n", F.lit(landing).alias("landing")).write.mode("append").insertInto(self._name)
        self._spark.catalog.refreshTable(self._name)

    def repeats_of(self, landing: str) -> DataFrame:
        """(digest, n_here, n_elsewhere): rows of a landing that other landings hold too. No shuffle of the ledger."""
        here = self.digests().where(F.col("landing") == landing).select("digest", F.col("n").alias("n_here"))
        rest = self.digests().where(F.col("landing") != landing).groupBy("digest").agg(F.sum("n").alias("n_elsewhere"))
        return here.join(rest, "digest")

    def summary(self) -> DataFrame:
        """DQ-3 over all landings."""
        totals = self.digests().groupBy("digest").agg(F.sum("n").alias("n"))
        counted = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"))
        return counted.withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_rows"))

    def groups(self) -> DataFrame:
        """DQ-4 over all landings: every repeated row with its count, most repeated first."""
        names = self._schema.fieldNames()
        known = self.landings()
        if not known:
            return self._spark.createDataFrame([], T.StructType([*self._schema.fields, T.StructField("duplicate_count", T.LongType())]))
        schema = T.StructType([*self._schema.fields, T.StructField("digest", T.BinaryType())])
        values = self._spark.read.schema(schema).parquet(*[f"{self._path}/groups/landing={x}" for x in known]).dropDuplicates(["digest"])
        totals = self.digests().groupBy("digest").agg(F.sum("n").alias("duplicate_count"))
        out = values.join(totals, "digest").select(*[f"`{n}`" for n in names], "duplicate_count")
        return out.orderBy(F.desc("duplicate_count"), *sort_keys(rest=names))
