"""Compares a query with its SQL in DuckDB on the fixture tables, as sets of rows with columns by name."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

from heddle.tables import NAMES

SF = "/root/testdata/sf0.001"


def there() -> bool:
    return Path(SF, "documents.parquet").exists()


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, query, sql: str) -> None:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(sql)
    columns, expected = [c[0] for c in con.description], con.fetchall()
    df = query(spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, expected)
