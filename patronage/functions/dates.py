"""Dates as naive wall-clock timestamps, and elapsed time in whole days."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import data_type, field
from patronage.errors import InputProblem
from patronage.functions.parse import stripped

# Days per time unit.
UNIT_DAYS = {"days": 1.0, "weeks": 7.0, "months": 30.4375}

# Days in these orders, each with an optional time. Tried in turn for text dates; callers with day-first
# slashes pass their own list. Single letters read one or two digits, brackets are optional.
CLOCK = "[' ']['T'][H:mm[:ss[.SSSSSSSSS]]]"
ISO = "ISO"
DATE_FORMATS = (ISO, f"d.M.yyyy{CLOCK}", f"M/d/yyyy{CLOCK}", f"yyyy/M/d{CLOCK}", "yyyyMMdd", "yyyyMMdd'T'HHmmss")
# What may be an ISO date, with any time and zone after it; the wall clock counts, not the zone.
ISO_LIKE = r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"


def unit_days(unit: str) -> float:
    if unit not in UNIT_DAYS:
        raise InputProblem(f"Time unit must be one of {', '.join(UNIT_DAYS)}, not {unit!r}.")
    return UNIT_DAYS[unit]


def date_column(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The column as TIMESTAMP_NTZ; text that fits none of the formats is NULL."""
    kind = data_type(df, column)
    if isinstance(kind, T.TimestampNTZType):
        return field(column)
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return field(column).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        text = stripped(field(column))
        return F.coalesce(*[_read(text, f) for f in formats])
    raise InputProblem(f"'{column}' holds {kind.simpleString()}, not dates.")


def _read(text: Column, form: str) -> Column:
    if form == ISO:
        return F.when(text.rlike(ISO_LIKE), text.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def moment(value: str | dt.date | dt.datetime) -> Column:
    """A given observation date; a date without a time is midnight."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ") if isinstance(value, dt.datetime) \
        else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def elapsed_days(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down (a negative part-day is -1).

    Elapsed time, not calendar days: 23:00 to 01:00 is 0.
    """
    gap = end - start
    whole = F.extract(F.lit("DAY"), gap)
    return F.when(gap < F.make_dt_interval(whole), whole - 1).otherwise(whole)


def elapsed_units(end: Column, start: Column, unit: str) -> Column:
    return elapsed_days(end, start) / F.lit(unit_days(unit))
