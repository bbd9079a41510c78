"""Small helpers for naming columns and for declaring what a row must satisfy."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.errors import InputProblem


def field(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value) -> Column:
    """Column for a column, a column name or a plain number."""
    if isinstance(value, Column):
        return value
    return field(value) if isinstance(value, str) else F.lit(value)


def names(keys: str | Sequence[str] | None) -> list[str]:
    """Key argument as a list: None, one name or several."""
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def require_columns(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise InputProblem(
            f"Not in the table: {', '.join(repr(c) for c in missing)}.",
            f"The table has {', '.join(repr(c) for c in df.columns)}.",
        )


def require_distinct_roles(roles: Mapping[str, str | None]) -> None:
    """One column may fill one role only; roles left at None do not count."""
    taken: dict[str, list[str]] = {}
    for role, column in roles.items():
        if column is not None:
            taken.setdefault(column, []).append(role)
    double = [f"'{c}' as {' and '.join(r)}" for c, r in taken.items() if len(r) > 1]
    if double:
        raise InputProblem(f"One column was given more than one role: {'; '.join(double)}.",
                           "Name a different column for each role.")


def data_type(df: DataFrame, column: str) -> T.DataType:
    require_columns(df, column)
    return df.schema[column].dataType


def invalid_reason(rules: Iterable[tuple[Column, str]]) -> Column:
    """First broken rule as text, NULL for a good row. A rule that is NULL counts as broken."""
    reason = F.lit(None).cast("string")
    for holds, text in reversed(list(rules)):
        reason = F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)).otherwise(reason)
    return reason


def reason_column(rules: Iterable[tuple[Column, str]], on_invalid: str = "null") -> Column:
    """``invalid_reason`` for a table: NULL for good rows; with ``'error'`` a broken row stops the job."""
    reason = invalid_reason(rules)
    return reason if on_invalid == "null" else F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))


def guarded(value: Column, rules: Iterable[tuple[Column, str]], on_invalid: str = "null") -> Column:
    """``value`` where every rule holds; elsewhere NULL, or an error when ``on_invalid='error'``.

    The error is part of the plan (``raise_error``), so strictness costs no extra pass.
    """
    if on_invalid not in ("null", "error"):
        raise InputProblem("on_invalid must be 'null' or 'error'.")
    reason = invalid_reason(rules)
    if on_invalid == "error":
        return F.when(reason.isNull(), value).otherwise(F.raise_error(reason))
    return F.when(reason.isNull(), value)
