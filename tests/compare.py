"""Runs a query in Spark and its SQL in DuckDB and compares the rows, regardless of their order."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import pandas as pd

import __spark_entry__ as entry


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, (pd.Timestamp, datetime.datetime)):
        return value.isoformat()
    value = value.item() if hasattr(value, "item") else value
    return float(value) + 0.0 if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = [[_cell(v) for v in df[c]] for c in sorted(df.columns)]
    return sorted(zip(*columns), key=repr)


def differences(spark, folder: str, name: str, db=None) -> str | None:
    """None when both sides agree, else what differs."""
    ours = entry.queries()[name](spark, folder).toPandas()
    theirs = (db or database(folder)).execute(entry.oracle_sql()[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours.columns}
    # Pandas holds whole numbers with missing values as floats on one side only.
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "O" not in k and not theirs[c].hasnans}
    a, b = rows(ours), rows(theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    return f"types differ: {odd}" if odd else None
