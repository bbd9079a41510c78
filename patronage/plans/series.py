"""Short period series (survivors, customer counts) packed into one row per segment.

A series has one row per period, so its length follows the calendar and not the customers. Rows are
merged per (segment, period) before a segment is gathered: what lands in one row is bounded by the
number of distinct periods, even if a segment holds a third of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, names, require_distinct_roles
from patronage.functions.parse import number_column


def pack_series(df: DataFrame, keys: str | Sequence[str] | None, period: str, value: str) -> DataFrame:
    """One row per segment: ``t`` and ``y`` as arrays in period order, and ``repeats`` if a period comes twice."""
    keys = names(keys)
    require_distinct_roles({"period": period, "value": value, **{f"key {k}": k for k in keys}})
    k = [field(c) for c in keys]
    rows = df.select(*k, number_column(df, period).alias("t"), number_column(df, value).alias("y")).where(
        F.col("t").isNotNull() & F.col("y").isNotNull())
    merged = rows.groupBy(*k, "t").agg(F.count("*").alias("n"), F.min("y").alias("y"))
    packed = merged.groupBy(*k).agg(
        F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s"), F.max(F.col("n") > 1).alias("repeats"))
    return packed.where(F.size("s") > 0).select(
        *k, F.transform("s", lambda e: e["t"]).alias("t"), F.transform("s", lambda e: e["y"]).alias("y"), "repeats")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
