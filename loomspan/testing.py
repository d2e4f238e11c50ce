"""Comparing a query with its SQL on the same tables, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            connection.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return connection


def _plain(x: object) -> object:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, sorted; floats to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, sql: str, connection: duckdb.DuckDBPyConnection) -> str:
    """What differs between a result and its SQL; empty if nothing does."""
    other = connection.execute(sql)
    names = [d[0] for d in other.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, SQL {sorted(names)}"
    expected, got = rows_of(names, other.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if expected == got:
        return ""
    first = next(((a, b) for a, b in zip(got, expected) if a != b), None)
    return f"{len(got)} rows, SQL {len(expected)}; first difference {first}"
