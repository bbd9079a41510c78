"""Rows dealt to so many tasks that the share of each is the same in every table.

Spark takes the number of partitions of a shuffle from a setting, so the memory of one task grows with the table. Where the
number of rows is known, it says how many tasks there are. Few rows are left to Spark, which may merge or send them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE_ROWS = 1 << 19
# Tables of at most so many shares are left to Spark.
FEW = 8


def tasks_for(rows: int) -> int:
    """Number of shares of so many rows; 0 if Spark may choose."""
    return -(-rows // SHARE_ROWS) if rows > FEW * SHARE_ROWS else 0


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df`` dealt by the columns ``by``; rows that agree in them meet in one task, so no key may hold a large part of them."""
    tasks = tasks_for(rows)
    return df.repartition(tasks, *[F.col(c) for c in by]) if tasks else df


def ordered(df: DataFrame, rows: int, *by) -> DataFrame:
    """``df`` in the order of the columns ``by`` over the whole table, in slices."""
    tasks = tasks_for(rows)
    return df.repartitionByRange(tasks, *by).sortWithinPartitions(*by) if tasks else df.orderBy(*by)
