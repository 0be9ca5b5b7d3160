"""Compares a registered query with its SQL text run by DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

# --- fixed values: DuckDB type of each Spark type ---
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}
# --- end of fixed values ---


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql) -> list[str]:
    """What differs between the DataFrame and the SQL result; empty if nothing."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description], strict=True))
    expected = _sorted(result.fetchall(), names)
    got = _sorted([tuple(r) for r in df.collect()], df.columns)
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    for name, kind in df.dtypes:
        if SAME_TYPE[kind] != types.get(name):
            problems.append(f"type of {name}: {kind} != {types.get(name)}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} != {len(expected)}")
    for a, b in zip(got, expected, strict=False):
        if a != b:
            problems.append(f"{a} != {b}")
            break
    return problems
