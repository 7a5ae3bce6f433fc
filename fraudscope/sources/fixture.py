"""Test fixture: a transaction table derived row by row from the ``events`` table.

The reference ships no raw data, so the shape under test is derived from the
driver's ``events`` table (one or two output rows per event, see FIXTURES.md).
Work grows linearly with ``events``: it is a single projection plus a
generator, fused into the scan's whole-stage codegen span; no shuffle.
Money is computed in DECIMAL and cast to DOUBLE last, so every engine agrees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fraudscope.schema import EPOCH, MONEY_TYPE, TXN_COLUMNS

_DEC = MONEY_TYPE

# Fixed values of the fixture definition (FIXTURES.md section 2).
# event_type -> transaction type: error -> TRANSFER, click -> CASH_OUT,
# signup -> CASH_IN, purchase -> PAYMENT, any other -> DEBIT.
EVENT_TYPE_TO_TXN = (
    ("error", "TRANSFER"),
    ("click", "CASH_OUT"),
    ("signup", "CASH_IN"),
    ("purchase", "PAYMENT"),
)
OTHER_TXN_TYPE = "DEBIT"


# Layout of the driver's ``events`` table (TESTDATA.md); declared, not inferred.
EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def _dec(sql: str) -> str:
    return f"CAST({sql} AS {_DEC})"


def _staged_exprs() -> list[str]:
    """Per-event helpers: transaction type, amount, origin and destination balance."""
    type_case = " ".join(f"WHEN event_type = '{ev}' THEN '{tx}'" for ev, tx in EVENT_TYPE_TO_TXN)
    return [
        "event_id AS e",
        "ts",
        "user_id",
        "event_type",
        f"CASE WHEN event_id % 1019 = 0 THEN CAST(NULL AS STRING) {type_case} ELSE '{OTHER_TXN_TYPE}' END AS t",
        f"""CASE WHEN event_id % 997 = 0 THEN {_dec('NULL')}
                 WHEN event_id % 991 = 0 THEN {_dec('0')}
                 WHEN event_id % 983 = 0 THEN {_dec('-12.50')}
                 ELSE {_dec("CAST(value AS DECIMAL(12,2)) * 4000 + CAST(event_id % 100 AS DECIMAL(12,2)) * CAST(0.01 AS DECIMAL(3,2))")}
            END AS amt""",
        _dec(
            """CASE event_id % 5 WHEN 0 THEN 0
                                 WHEN 1 THEN 1 + (event_id * 31) % 1000
                                 WHEN 2 THEN 1001 + (event_id * 31) % 9000
                                 WHEN 3 THEN 10001 + (event_id * 31) % 90000
                                 ELSE 100001 + (event_id * 31) % 900000 END"""
        )
        + " AS ob",
        _dec(
            """CASE WHEN event_type = 'purchase' THEN (CASE WHEN event_id % 11 = 0 THEN NULL ELSE 0 END)
                    WHEN event_id % 7 = 0 THEN 0
                    ELSE (event_id * 17) % 500000 END"""
        )
        + " AS od",
    ]


def _row_exprs() -> list[str]:
    """The transaction columns, plus the generator that emits every 500th event twice."""
    return [
        # whole hours since EPOCH on zone-less timestamps (no session time zone involved)
        f"CAST(CAST(ts - TIMESTAMP_NTZ '{EPOCH}' AS INTERVAL HOUR) AS BIGINT) + 1 AS step",
        "t AS type",
        "CAST(amt AS DOUBLE) AS amount",
        "concat('C', CAST(user_id AS STRING)) AS nameOrig",
        "CAST(ob AS DOUBLE) AS oldbalanceOrg",
        f"CAST(CASE WHEN e % 3 = 0 THEN {_dec('0')} ELSE ob - amt END AS DOUBLE) AS newbalanceOrig",
        """CASE WHEN e % 1013 = 0 THEN CAST(NULL AS STRING)
                WHEN event_type = 'purchase' THEN concat('M', CAST(e % 97 AS STRING))
                ELSE concat('C', CAST((user_id * 7 + e) % 150 AS STRING)) END AS nameDest""",
        "CAST(od AS DOUBLE) AS oldbalanceDest",
        "CAST(CASE WHEN e % 4 = 0 THEN od ELSE od + amt END AS DOUBLE) AS newbalanceDest",
        """CAST(CASE WHEN e % 1009 = 0 THEN NULL
                     WHEN t IN ('TRANSFER', 'CASH_OUT') AND (e % 35 = 4 OR e % 101 = 7) THEN 1
                     ELSE 0 END AS BIGINT) AS isFraud""",
        "CAST(CASE WHEN t = 'TRANSFER' AND amt > 200000 AND e % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS isFlaggedFraud",
        "explode(array_repeat(0, CASE WHEN e % 500 = 0 THEN 2 ELSE 1 END)) AS _copy",
    ]


def fixture_from_events(events: DataFrame) -> DataFrame:
    """Two SQL projections (and a generator), built JVM-side in a handful of calls."""
    return events.selectExpr(*_staged_exprs()).selectExpr(*_row_exprs()).select(*TXN_COLUMNS)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture transaction table for a scale-factor folder."""
    return fixture_from_events(read_events(spark, sf_dir))


def stream_fixture(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The fixture as a stream: new ``events*.parquet`` files in ``sf_dir`` become rows.

    ``max_files_per_trigger`` bounds one micro-batch of a feed in time order; by
    default all files that are there make one.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events*.parquet")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return fixture_from_events(reader.parquet(sf_dir))
