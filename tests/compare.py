"""Compare a Spark result with its check SQL in DuckDB, without regard to row order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from quayline.sources.derived import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    if isinstance(value, datetime.datetime):
        return "timestamp"
    return type(value).__name__


def canonical(value):
    if isinstance(value, float) and math.isnan(value):
        return ("nan",)
    if isinstance(value, float):
        return ("float", repr(round(value, 6)))
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return ("timestamp", value.replace(tzinfo=None).isoformat())
    return (kind(value), str(value))


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when both agree, else a short account of what differs."""
    ours = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = table(names, result.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if ours == theirs:
        return None
    only_ours = sorted(set(ours) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(ours))[:2]
    return f"rows {len(ours)} / {len(theirs)}; spark only {only_ours}; check only {only_theirs}"
