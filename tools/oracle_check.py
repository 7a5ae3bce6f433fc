"""Spark-versus-DuckDB parity check (the same contract the driver applies).

Column names are compared as sets, then rows are compared as multisets after
sorting columns by name; floats must be equal exactly (both sides sum money
as decimals, so they are).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return ("nan",)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return v.item()
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0) for x in row)


@dataclass
class Result:
    ok: bool
    message: str
    spark_rows: int
    oracle_rows: int


_SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


def type_mismatches(spark_df, rel) -> list[str]:
    """Columns whose Spark type does not correspond to the oracle's DuckDB type."""
    duck = {d[0]: str(d[1]) for d in rel.description}
    out = []
    for f in spark_df.schema.fields:
        want = _SPARK_TO_DUCK.get(f.dataType.simpleString())
        got = duck.get(f.name)
        if want is not None and got is not None and got != want:
            out.append(f"{f.name}: spark {f.dataType.simpleString()} vs oracle {got}")
    return out


def compare(spark_df, sql: str, con) -> Result:
    sp_cols = spark_df.columns
    rel = con.execute(sql)
    ora_cols = [d[0] for d in rel.description]
    types = type_mismatches(spark_df, rel)
    ora_rows = rel.fetchall()
    sp_rows = [tuple(r) for r in spark_df.collect()]
    if sorted(sp_cols) != sorted(ora_cols):
        return Result(False, f"columns differ: spark={sp_cols} oracle={ora_cols}", len(sp_rows), len(ora_rows))
    if types:
        return Result(False, f"types differ: {types}", len(sp_rows), len(ora_rows))
    order = sorted(range(len(sp_cols)), key=lambda i: sp_cols[i])
    oorder = [ora_cols.index(sp_cols[i]) for i in order]
    a = sorted((tuple(_norm(r[i]) for i in order) for r in sp_rows), key=_key)
    b = sorted((tuple(_norm(r[i]) for i in oorder) for r in ora_rows), key=_key)
    if len(a) != len(b):
        return Result(False, f"row count spark={len(a)} oracle={len(b)}", len(a), len(b))
    names = [sp_cols[i] for i in order]
    for ra, rb in zip(a, b):
        if ra != rb:
            diffs = [(n, x, y) for n, x, y in zip(names, ra, rb) if x != y]
            return Result(False, f"first differing row: {diffs[:4]}", len(a), len(b))
    return Result(True, "ok", len(a), len(b))
