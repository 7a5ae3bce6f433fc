"""Every registered query equals its DuckDB oracle at sf0.01 (the driver's gate)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from fraudscope.plans.catalog import QUERIES
from tests.conftest import SF01

KEYS = sorted(QUERIES)  # the training-data queries have their own tests


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_parity(spark, duck01, key):
    from tools.oracle_check import compare

    df = entry_mod.queries()[key](spark, SF01)
    r = compare(df, entry_mod.oracle_sql()[key], duck01)
    assert r.ok, r.message


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 3
    assert df.columns[0] == "threshold_name"
