"""Run a query and its SQL on the same tables and compare the rows without regard to order."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime | date):
        return str(v)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str:
    """Empty when both sides agree, else what differs."""
    found = rows_of(df.columns, df.collect())
    result = con.sql(sql)
    names = list(result.columns)
    expected = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {c: type(v) for r in [df.limit(200).collect()] for row in r for c, v in row.asDict().items() if v is not None}
    for row in result.limit(200).fetchall():
        for c, v in zip(names, row, strict=True):
            if v is not None and c in kinds and kinds[c] is not type(v):
                return f"type of {c}: {kinds[c].__name__} and {type(v).__name__}"
    if found == expected:
        return ""
    mine, theirs = found - expected, expected - found
    return f"{sum(mine.values())} extra {list(mine)[:3]}; {sum(theirs.values())} missing {list(theirs)[:3]}; {sum(found.values())} rows"
