"""Text to numbers, 0/1 answers, event classes, and cells that are safe in a spreadsheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import data_type, field

# Answers read as 1 and as 0.
YES_WORDS = ("yes", "y", "true", "ja")
NO_WORDS = ("no", "n", "false", "nei")

# What a spreadsheet would run, and characters it cannot store.
FORMULA_START = r"^[ \t\r\n]*[=+@-]"
UNSTORABLE = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"

# Plain decimal numbers only: the JVM would also read '1d', '1f' and hexadecimal floats.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i)[+-]?inf(inity)?$"


# White space around a cell that does not belong to its value: blanks of any kind, tabs and line ends.
AROUND = " \t\r\n\v\f\u00a0\u2007\u202f\ufeff"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(AROUND))


def no_nan(value: Column) -> Column:
    """NaN is a missing value here, never the largest number."""
    return F.nullif(value, F.lit(float("nan")))


def text_to_number(text: Column) -> Column:
    trimmed = stripped(text)
    return no_nan(F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double")))


def number_column(df: DataFrame, column: str) -> Column:
    """The column as DOUBLE; whatever cannot be read as a number is NULL."""
    kind = data_type(df, column)
    if isinstance(kind, T.StringType):
        return text_to_number(field(column))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return no_nan(field(column).cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return field(column).cast("double")
    return field(column).cast("string").try_cast("double")


def binary_column(df: DataFrame, column: str) -> Column:
    """Yes/no words as 1/0, anything else as its number (the caller checks for other values)."""
    kind = data_type(df, column)
    if not isinstance(kind, T.StringType):
        return number_column(df, column)
    word = F.lower(stripped(field(column)))
    return (
        F.when(word.isin(*YES_WORDS), F.lit(1.0))
        .when(word.isin(*NO_WORDS), F.lit(0.0))
        .otherwise(text_to_number(field(column)))
    )


def event_word(event_type: Column) -> Column:
    return F.lower(stripped(event_type.cast("string")))


def is_purchase(event_type: Column) -> Column:
    """True when the type holds 'purchase' or 'order' ('reorder' too); a missing type is False."""
    return F.coalesce(event_word(event_type).rlike("purchase|order"), F.lit(False))


def is_complaint(event_type: Column) -> Column:
    return F.coalesce(event_word(event_type).contains("complaint"), F.lit(False))


def classify_event(event_type: Column) -> Column:
    """Both marks as a struct; one event may carry both."""
    return F.struct(is_purchase(event_type).alias("purchase"), is_complaint(event_type).alias("complaint"))


def neutralize(text: Column) -> Column:
    """Cell text that no spreadsheet runs as a formula."""
    clean = F.regexp_replace(text, UNSTORABLE, "")
    return F.when(clean.rlike(FORMULA_START), F.concat(F.lit("'"), clean)).otherwise(clean)
