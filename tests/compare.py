"""Comparison of a Spark result with the SQL result over the same tables."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns in order of name, sorted, with types told apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple((type(row[i]).__name__, _text(row[i])) for i in order) for row in rows)


def _text(value) -> str:
    """Text of a value; adding zero makes one of the two zeros."""
    return repr(value + 0.0 if isinstance(value, float) else value)


def differences(frame, connection, sql: str) -> str | None:
    """None when both results agree in names, types, rows and values."""
    got = [tuple(row) for row in frame.collect()]
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    left, right = rows_of(frame.columns, got), rows_of(names, want)
    if left == right:
        return None
    only = [row for row in left if row not in set(right)][:2], [row for row in right if row not in set(left)][:2]
    return f"{len(left)} rows != {len(right)} rows; {only}" if len(left) != len(right) else f"values: {only}"
