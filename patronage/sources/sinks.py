"""Result tables as CSV, parquet or JSON."""

from __future__ import annotations

import functools
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import field, names
from patronage.errors import InputProblem
from patronage.operators.prep import neutralize_formulas
from patronage.scratch import stored


def _writer(df: DataFrame, mode: str, partition_by):
    keys = names(partition_by)
    # Rows of one partition value may be split over several files, so a hot value is not one task.
    writer = df.write.mode(mode)
    return writer.partitionBy(*keys) if keys else writer


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
                partition_by: str | Sequence[str] | None = None, safe: bool | None = None) -> None:
    """One result table as parquet or CSV.

    CSV is made to be opened in a spreadsheet, so its text cells are neutralised unless ``safe=False``.
    """
    if fmt not in ("parquet", "csv"):
        raise InputProblem(f"Unknown format {fmt!r}; use 'parquet' or 'csv'.")
    if fmt == "parquet":
        _writer(df, mode, partition_by).parquet(path)
        return
    out = df if safe is False else neutralize_formulas(df)
    nested = (T.ArrayType, T.MapType, T.StructType)
    out = out.select(*[
        (F.to_json(field(f.name)).alias(f.name) if isinstance(f.dataType, nested) else field(f.name))
        for f in out.schema.fields])
    _writer(out, mode, partition_by).csv(path, header=True, escape='"', quoteAll=False)


def _json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities are no JSON numbers and turn null; dates turn text."""
    def cell(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = field(f.name)
            finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
            return F.when(finite, c).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return field(f.name).cast("string").alias(f.name)
        return field(f.name)

    return df.select(*map(cell, df.schema.fields))


def write_json_records(tables: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """Each table as JSON lines under ``path/<table>``; missing values are written as null."""
    for name, df in tables.items():
        _json_safe(df).write.mode(mode).option("ignoreNullFields", False).json(f"{path}/{name}")


def json_document(tables: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """All tables as one object ``{table: [records]}`` in a single text file, a record per line.

    Records are turned to text and written where they lie. One task then copies them, in order, between the lines that
    open and close the lists; it holds no more than a line, whatever the size of the document.
    """
    if not tables:
        raise InputProblem("There is no table to write.")
    parts, last = [], len(tables) - 1
    for position, (name, df) in enumerate(tables.items()):
        spark = df.sparkSession
        records = stored(_json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line")).withColumn(
            "place", F.monotonically_increasing_id()), "records")
        first = records.agg(F.min("place")).scalar()
        comma = F.when(F.col("place") == first, "").otherwise(",")
        frame = spark.createDataFrame([(0, ("{" if position == 0 else "") + json.dumps(name, ensure_ascii=False) + ": ["),
                                       (2, "]}" if position == last else "],")], "kind int, value string")
        lines = records.select(F.lit(1).alias("kind"), "place", F.concat(comma, F.col("line")).alias("value")).unionByName(
            frame.select("kind", F.lit(0).cast("long").alias("place"), "value"))
        parts.append(lines.withColumn("position", F.lit(position)))
    ordered = functools.reduce(DataFrame.unionByName, parts).orderBy("position", "kind", "place")
    ordered.select("value").coalesce(1).write.mode(mode).text(path)
