from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fraudscope.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="fraudscope-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def txn01(spark):
    from fraudscope.sources import transactions

    return transactions(spark, SF01).cache()


@pytest.fixture(scope="session")
def duck01():
    from tools.oracle_check import duckdb_connection

    return duckdb_connection(SF01)


@pytest.fixture(scope="session")
def landed01(spark, txn01):
    """The sf0.01 fixture landed as Parquet (the production read path)."""
    from fraudscope.session import scratch_path
    from fraudscope.sources import land_parquet, read_transactions

    path = scratch_path(spark, "test-landed")
    land_parquet(txn01.repartition(4), path)
    return read_transactions(spark, path)
