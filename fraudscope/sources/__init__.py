"""Sources: the transaction table from CSV / Parquet / a stream, and the test fixture."""

from fraudscope.sources.fixture import fixture_from_events, read_events, stream_fixture, transactions
from fraudscope.sources.landing import TooManyRejects, land_csv, read_landing, read_rejects
from fraudscope.sources.tables import (
    land_by_period,
    land_parquet,
    preview,
    read_periods,
    read_transactions,
    register_views,
    stream_transactions,
)

__all__ = [
    "TooManyRejects",
    "fixture_from_events",
    "land_by_period",
    "land_csv",
    "land_parquet",
    "preview",
    "read_events",
    "read_landing",
    "read_periods",
    "read_rejects",
    "read_transactions",
    "register_views",
    "stream_fixture",
    "stream_transactions",
    "transactions",
]
