"""Reading columns by role, describing tables, and making them safe to export."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.functions.dates import DATE_FORMATS, date_column
from patronage.functions.parse import FORMULA_START, UNSTORABLE, binary_column, neutralize, number_column

# Longest example shown, most levels a text predictor may have, predictors proposed.
EXAMPLE_LENGTH = 100
PREDICTOR_LEVELS = 20
PREDICTOR_COUNT = 8


def _samples(df: DataFrame, column: str) -> str:
    """Three readable values of a column for an error message."""
    rows = df.select(field(column).cast("string").alias("v")).where(F.col("v").isNotNull()).limit(3).collect()
    return ", ".join(f"'{r['v'][:40]}'" for r in rows) or "no values"


def require_numbers(df: DataFrame, labels: dict[str, str], minimum_rows: int = 1) -> None:
    """Every named column must hold enough readable numbers; one pass over all of them."""
    found = df.agg(F.count("*").alias("rows"), *[
        F.count(number_column(df, c)).alias(f"_{i}") for i, c in enumerate(labels)]).first()
    for i, (column, label) in enumerate(labels.items()):
        usable = found[f"_{i}"]
        if not usable:
            raise InputProblem(
                f"No cell of '{column}' ({label}) reads as a number; it holds {_samples(df, column)}.",
                "Take out currency signs, blanks and decimal commas before loading.")
        if usable < minimum_rows:
            raise InputProblem(f"'{column}' ({label}) has {usable:,} readable numbers in {found['rows']:,} rows; "
                               f"at least {minimum_rows} are needed.")


def coerce_numeric(df: DataFrame, column: str, label: str | None = None, minimum_rows: int = 1) -> DataFrame:
    """The table with ``column`` as DOUBLE; unreadable cells turn NULL. Too few readable rows is an error."""
    require_columns(df, column)
    require_numbers(df, {column: label or column}, minimum_rows)
    return df.withColumn(column, number_column(df, column))


def coerce_date(df: DataFrame, column: str, label: str | None = None,
                formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """The table with ``column`` as TIMESTAMP_NTZ; the first format that fits a cell wins."""
    out = df.withColumn(column, date_column(df, column, formats))
    if not out.agg(F.count(field(column))).first()[0]:
        raise InputProblem(f"No cell of '{column}' ({label or column}) fits a date format; "
                           f"it holds {_samples(df, column)}.", "Pass the formats the column uses.")
    return out


def coerce_binary(df: DataFrame, column: str, label: str | None = None) -> DataFrame:
    """The table with ``column`` as 0/1 (yes/no words are read); any other number is an error."""
    label = label or column
    out = df.withColumn(column, binary_column(df, column))
    values = out.where(field(column).isNotNull())
    extras = [r[0] for r in values.where(~field(column).isin(0.0, 1.0)).select(field(column)).distinct()
              .orderBy(field(column)).limit(5).collect()]
    if extras:
        raise InputProblem(f"'{column}' ({label}) must hold 0 and 1 only, yet it has {', '.join(map(str, extras))}.")
    if values.isEmpty():
        raise InputProblem(f"No cell of '{column}' ({label}) reads as 0, 1, yes or no; "
                           f"it holds {_samples(df, column)}.")
    return out


def unreadable_rows(before: DataFrame, roles: dict[str, str]) -> DataFrame:
    """How many rows each role would skip: (column, role, rows, skipped), in one pass.

    ``roles`` maps a column to 'number', 'date' or 'binary'.
    """
    readers = {"number": number_column, "date": date_column, "binary": binary_column}
    unknown = set(roles.values()) - set(readers)
    if unknown:
        raise InputProblem(f"Unknown role {sorted(unknown)}; use {sorted(readers)}.")
    counts = before.agg(F.count("*").alias("rows"), *[
        F.count(readers[role](before, c)).alias(f"_{i}") for i, (c, role) in enumerate(roles.items())])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(role).alias("role"), F.col("rows"),
                 (F.col("rows") - F.col(f"_{i}")).alias("skipped"))
        for i, (c, role) in enumerate(roles.items())])).alias("r")).select("r.*")


def _missing(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    c = field(column)
    return c.isNull() | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c.isNull()


def profile_table(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, non-missing rows, missing share, distinct values, an example.

    Plain counts and the example (the smallest value) come from one pass. Exact distinct counts come
    from one distinct per (column, value) pair of a long table, which splits every column's values
    over all tasks; ``approximate`` uses sketches in the first pass instead.
    """
    cells = {f.name: F.when(~_missing(df, f.name), field(f.name)) for f in df.schema.fields}
    text = {n: c.cast("string") for n, c in cells.items()}
    order = {n: i for i, n in enumerate(cells)}
    plain = [F.count("*").alias("rows")]
    for n, i in order.items():
        orderable = not isinstance(df.schema[n].dataType, (T.MapType, T.VariantType))
        plain += [F.count(cells[n]).alias(f"n{i}"),
                  F.min(cells[n] if orderable else text[n]).cast("string").alias(f"x{i}")]
        if approximate:
            plain.append(F.approx_count_distinct(text[n]).alias(f"d{i}"))
    counts = df.agg(*plain)

    def row(n: str, i: int, distinct):
        share = 1 - F.col(f"n{i}") / F.when(F.col("rows") > 0, F.col("rows"))
        return F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("column"),
            F.lit(df.schema[n].dataType.simpleString()).alias("type"),
            F.col(f"n{i}").alias("non_missing"), share.alias("missing_pct"),
            distinct.alias("unique"),
            F.coalesce(F.substring(f"x{i}", 1, EXAMPLE_LENGTH), F.lit("")).alias("example"))

    unknown = F.lit(0).cast("long")
    described = counts.select(F.explode(F.array(*[
        row(n, i, F.col(f"d{i}") if approximate else unknown) for n, i in order.items()
    ])).alias("r")).select("r.*")
    if not approximate:
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("position"), _digest(text[n]).alias("value"))
            for n, i in order.items()])).alias("p")).select("p.*").where(F.col("value").isNotNull())
        distinct = pairs.distinct().groupBy("position").agg(F.count("*").alias("_distinct"))
        described = described.join(distinct, "position", "left").withColumn(
            "unique", F.coalesce("_distinct", F.lit(0).cast("long"))).drop("_distinct")
    return described.orderBy("position").drop("position")


def _digest(text: Column) -> Column:
    """Long texts as their 256-bit digest, shorter ones as they are: the lengths tell them apart."""
    return F.when(F.octet_length(text) < 32, text.cast("binary")).otherwise(F.unhex(F.sha2(text, 256)))


def table_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and rows that repeat an earlier row.

    Rows are compared by their numbers and by texts of up to 31 bytes or the SHA-256 of longer ones, so no long text is shuffled.
    """
    texts = (T.StringType, T.BinaryType)
    keys = [_digest(field(f.name)) if isinstance(f.dataType, texts) else field(f.name) for f in df.schema.fields]
    groups = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(
        F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def preview(df: DataFrame, order: str | Sequence[str], rows: int = 100) -> DataFrame:
    """The first rows in a stated order (a distributed top-k, not a full sort)."""
    order = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*map(field, order)).limit(rows)


def usable_predictors(df: DataFrame, outcome: str, ids: Sequence[str] = (), limit: int = PREDICTOR_COUNT,
                      approximate: bool = False) -> list[str]:
    """Columns that can carry signal: not the outcome or an id, neither constant nor all distinct,
    and numeric or with few levels. The first ``limit`` in column order."""
    require_columns(df, outcome)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    keep = []
    for r in profile_table(df, approximate).collect():  # one row per column
        name, levels = r["column"], r["unique"]
        if name == outcome or name in ids or levels <= 1 or levels == r["non_missing"]:
            continue
        if name in numeric or levels <= PREDICTOR_LEVELS:
            keep.append(name)
    return keep[:limit]


def _safe_header(name: str) -> str:
    import re
    clean = re.sub(UNSTORABLE, "", name)
    return "'" + clean if re.match(FORMULA_START, clean) else clean


def dedupe_headers(headers: Sequence[str]) -> list[str]:
    """Trimmed, non-empty, distinct headers; repeats get __2, __3, ...

    Names that differ only in case count as repeats too, because Spark resolves them alike.
    """
    taken: dict[str, str] = {}  # lower-cased name: the header, in order
    for place, header in enumerate(headers, 1):
        wanted = str(header).strip() or f"column_{place}"
        choices = itertools.chain([wanted], (f"{wanted}__{n}" for n in itertools.count(2)))
        chosen = next(c for c in choices if c.lower() not in taken)
        taken[chosen.lower()] = chosen
    return list(taken.values())


def neutralize_formulas(df: DataFrame) -> DataFrame:
    """Headers and text cells that no spreadsheet program runs as formulas."""
    headers = dedupe_headers([_safe_header(c) for c in df.columns])
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return positional.select(*[
        (neutralize(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.col(f.name)).alias(h)
        for f, h in zip(positional.schema.fields, headers)])
