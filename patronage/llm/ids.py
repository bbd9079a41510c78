"""Ids and names of columns that operators add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patronage.columns import require_columns
from patronage.errors import InputProblem


def require_whole_ids(df: DataFrame, *columns: str) -> None:
    """Operators that order documents by id, or return ids as long, take whole numbers only."""
    require_columns(df, *columns)
    for c in columns:
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.IntegralType, T.NullType)) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
            raise InputProblem(f"'{c}' holds {kind.simpleString()}, not whole numbers.", "Number the rows first.")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the table is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
