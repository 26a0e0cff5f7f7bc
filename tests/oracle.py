"""Compare the rows of a frame with those of its SQL twin."""

from __future__ import annotations

import datetime as dt
import decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(frame, connection, sql: str) -> str | None:
    """None when both give the same rows, else what differs first."""
    ours = rows_of(frame.columns, frame.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows: {str(wrong[0])[:400]}"
    kinds = {n: (type(a), type(b)) for n, a, b in zip(sorted(names), ours[0], theirs[0])} if ours else {}
    mixed = {n: k for n, k in kinds.items() if k[0] is not k[1] and None not in (k[0], k[1]) and type(None) not in k}
    return f"types {mixed}" if mixed else None
