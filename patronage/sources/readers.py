"""CSV, JSON and parquet as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from patronage.columns import field
from patronage.errors import InputProblem
from patronage.scratch import scratch_path, stored


def read_csv_table(spark: SparkSession, path, schema: T.StructType | str | None = None,
                   multiline: bool = False) -> DataFrame:
    """A CSV file or folder with a header row.

    Without a schema every column is text: no inference pass over the data, and the operators read
    each column by its role. A file is split over tasks, for which a record must be a line;
    ``multiline`` allows line breaks inside quoted cells, and then a file is one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_parquet_table(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested records as dotted columns: ``{"a": {"b": 1}}`` gives ``a.b``. Lists stay lists."""
    def leaves(schema: T.StructType, column, name: str):
        for f in schema.fields:
            inner = column.getField(f.name) if column is not None else field(f.name)
            label = f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, inner, label)
            else:
                yield inner.alias(label)

    return df.select(*leaves(df.schema, None, ""))


def _before(rows: DataFrame, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows of a file that stand before each row: within its block, and over earlier blocks.

    A window holds the rows of one block, whose size Spark bounds, or one row per block of a file.
    """
    own = W.partitionBy("file", "block").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum(amount).alias("all")).select(
        "file", "block", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    return rows.withColumn(name, F.coalesce(F.sum(amount).over(own), F.lit(0))).join(blocks, ["file", "block"]).withColumn(
        name, F.col(name) + F.col("base")).drop("base")


def list_elements(spark: SparkSession, path) -> DataFrame:
    """``value``: one row per record of JSON files that each hold a list of records, or one record. UTF-8.

    A file is cut behind every closing brace, by all tasks that read a part of it. Which of the braces close a record
    follows from running counts: of quotes, which tell whether a brace stands in a text, and then of open braces. What is
    left of a file that breaks off is a row of its own. Line breaks become blanks, so every record fits a line.
    """
    def number_of(text, mark: str):
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def outside(text):
        return F.regexp_replace(text, '"[^"]*("|$)', "")

    bare = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.translate("value", "\r\n", "  ").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    # Written: the counts below read the narrow columns several times, the texts once.
    rows = stored(pieces.select(
        "*", number_of(bare, '"').alias("quotes"), number_of(outside(bare), "{").alias("opened"),
        number_of(outside(F.regexp_replace(bare, '^[^"]*("|$)', "")), "{").alias("opened_from_text")), "json-pieces")
    rows = _before(rows, "quotes", "quotes_before")
    within = F.col("quotes_before") % 2 == 1
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("int")
    rows = _before(rows.withColumn("change", F.when(within, F.col("opened_from_text")).otherwise(F.col("opened")) - closes),
                   "change", "depth")
    rows = rows.withColumn("ends", ((closes == 1) & (F.col("depth") + F.col("change") == 0)).cast("int"))
    rows = _before(rows, "ends", "record")
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "value")))
    whole = rows.groupBy("file", "record").agg(parts.alias("parts"), F.max("ends").alias("whole")).select(
        F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"),
                 F.when(F.col("whole") == 1, "}").otherwise("")).alias("value"))
    return whole.where(F.contains("value", F.lit("{"))).select(F.regexp_replace("value", r"^[^{]*", "").alias("value"))


def read_json_records(spark: SparkSession, path, schema: T.StructType | str | None = None,
                      lines: bool = True) -> DataFrame:
    """One record per line, or without ``lines`` a list of records per file, as one flat table.

    Both are read by several tasks: a list is first written as lines (``list_elements``).
    """
    if not lines:
        own = scratch_path(spark, "json-lines")
        list_elements(spark, path).write.text(own)
        path = own
    return flatten_structs((spark.read.schema(schema) if schema is not None else spark.read).json(path))


def read_json_tables(spark: SparkSession, path, schema: T.StructType | str | None = None) -> dict[str, DataFrame]:
    """A JSON file as named tables.

    A list of records is the table ``data``. An object gives one table per list or record it holds,
    and its plain values become the one-row table ``summary``. A bare value is ``data`` with the
    column ``value``. A byte order mark is skipped.
    """
    head = spark.read.text(path).select(F.regexp_extract("value", r"^[\uFEFF\s]*(\S)", 1).alias("first")).where(
        F.col("first") != "").first()
    if head is None:
        raise InputProblem(f"Nothing to read at {path}.")
    if head["first"] == "[":
        return {"data": read_json_records(spark, path, schema, lines=False)}
    if head["first"] != "{":
        text = spark.read.text(path, wholetext=True)
        bare = F.trim(F.regexp_replace("value", r"^\uFEFF", ""))
        unquoted = F.regexp_replace(bare, r'^"|"$', "")
        return {"data": text.select(F.when(bare != "null", unquoted).alias("value"))}
    reader = spark.read.option("multiLine", True)
    document = (reader.schema(schema) if schema is not None else reader).json(path)
    tables: dict[str, DataFrame] = {}
    plain = [f.name for f in document.schema.fields
             if not isinstance(f.dataType, (T.ArrayType, T.StructType))]
    if plain:
        tables["summary"] = document.select(*map(field, plain))
    for f in document.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            items = document.select(F.explode(field(f.name)).alias("item"))
            if isinstance(f.dataType.elementType, T.StructType):
                tables[f.name] = flatten_structs(items.select("item.*"))
            else:
                tables[f.name] = items.select(F.col("item").alias("0"))
        elif isinstance(f.dataType, T.StructType):
            tables[f.name] = flatten_structs(document.select(field(f.name).alias("item")).select("item.*"))
    return tables
