"""Reading, describing, cleaning and writing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.operators import prep
from patronage.scratch import scratch_path
from patronage.sources import readers, sinks
from queries import query, rounded, table


def messy(spark, folder):
    """Orders as a careless export would hold them: currency marks, yes/no words, mixed dates."""
    status, key, date = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_orderdate")
    price = F.format_string("%.2f", F.col("o_totalprice"))
    return table(spark, folder, "orders").select(
        key, F.when(status == "P", F.concat(F.lit("kr "), price)).otherwise(F.concat(F.lit(" "), price)).alias("amount"),
        F.when(key % 7 == 0, F.lit("unknown")).when(key % 2 == 0, F.date_format(date, "dd.MM.yyyy"))
        .otherwise(F.date_format(date, "yyyy-MM-dd")).alias("day"),
        F.when(status == "F", " Yes").when(status == "O", "nei").alias("closed"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 6) END AS amount,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS day,
       CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS closed
FROM orders""")
def coerced_columns(spark, folder):
    out = prep.coerce_numeric(messy(spark, folder), "amount", "transaction amount")
    out = prep.coerce_date(out, "day", "purchase date")
    return rounded(prep.coerce_binary(out, "closed", "response"))


@query("""
SELECT 'amount' AS "column", 'number' AS role, count(*) AS rows,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS skipped FROM orders
UNION ALL SELECT 'day', 'date', count(*), count(*) FILTER (WHERE o_orderkey % 7 = 0) FROM orders
UNION ALL SELECT 'closed', 'binary', count(*), count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders""")
def unreadable_counts(spark, folder):
    return prep.unreadable_rows(messy(spark, folder), {"amount": "number", "day": "date", "closed": "binary"})


def _profile_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS non_missing,
       round(1 - count({c}) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS "unique",
       coalesce(left({example}, 100), '') AS example FROM {source}""" for c, kind, example in columns)


@query(_profile_sql("documents", [
    ("doc_id", "bigint", "min(doc_id)::VARCHAR"), ("text", "string", "min(text)"), ("lang", "string", "min(lang)"),
    ("source", "string", "min(source)"), ("n_chars", "bigint", "min(n_chars)::VARCHAR")]))
def profile_of_documents(spark, folder):
    return rounded(prep.profile_table(table(spark, folder, "documents")))


@query(_profile_sql("conversations", [
    ("conv_id", "bigint", "min(conv_id)::VARCHAR"), ("turn", "bigint", "min(turn)::VARCHAR"),
    ("role", "string", "min(role)"), ("text", "string", "min(text)")]))
def profile_of_conversations(spark, folder):
    return rounded(prep.profile_table(table(spark, folder, "conversations")))


@query("""
SELECT CAST(sum(n) AS BIGINT) AS rows, 6 AS columns, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM events GROUP BY event_id, ts, user_id, event_type, value, props)""")
def shape_of_events(spark, folder):
    return prep.table_shape(table(spark, folder, "events"))


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 100")
def preview_of_customers(spark, folder):
    return prep.preview(table(spark, folder, "customer"), "c_custkey")


@query("""
SELECT conv_id, turn, regexp_replace(role, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS "'=role",
  CASE WHEN regexp_matches(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '^[ \\t\\r\\n]*[=+@-]')
       THEN '''' || regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')
       ELSE regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') END AS text,
  concat(CASE conv_id % 4 WHEN 0 THEN '''=' WHEN 1 THEN ''' -' WHEN 2 THEN '''@' ELSE '' END,
         regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS text__2
FROM conversations""")
def safe_conversations(spark, folder):
    """Whole texts; a formula-like header, a repeated header, and texts given formula-like starts."""
    conversations = table(spark, folder, "conversations")
    start = F.element_at(F.array(F.lit("="), F.lit(" -"), F.lit("@"), F.lit("")), (F.col("conv_id") % 4 + 1).cast("int"))
    # A text that starts like a formula by itself would be marked in the fourth case as well.
    return prep.neutralize_formulas(conversations.select(
        "conv_id", "turn", F.col("role").alias("=role"), "text", F.concat(start, "text").alias("text ")))


@query("""
SELECT doc_id, lang, CASE WHEN regexp_matches(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'),
                                              '^[ \\t\\r\\n]*[=+@-]') THEN '''' ELSE '' END
       || regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents""")
def safe_documents(spark, folder):
    return prep.neutralize_formulas(table(spark, folder, "documents").select("doc_id", "lang", "text"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def csv_round_trip(spark, folder):
    """Orders written as CSV and read back by role; the date is text in between."""
    path = scratch_path(spark, "csv")
    sinks.write_table(table(spark, folder, "orders"), path, "csv")
    text = readers.read_csv_table(spark, path)
    read = prep.coerce_numeric(text, "o_totalprice")
    read = prep.coerce_date(read, "o_orderdate")
    return read.withColumns({k: F.col(k).cast("long") for k in ("o_orderkey", "o_custkey")})


@query("""
SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents""")
def csv_round_trip_of_texts(spark, folder):
    """Whole documents with line breaks, quotes and commas survive the CSV unharmed."""
    path = scratch_path(spark, "csv")
    documents = table(spark, folder, "documents").select("doc_id", F.regexp_replace(
        "text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "").alias("text"))
    sinks.write_table(documents, path, "csv", safe=False)
    return readers.read_csv_table(spark, path, "doc_id BIGINT, text STRING", multiline=True)


@query("""
SELECT c_custkey, c_name AS "who.name", c_acctbal AS "who.money.balance", c_mktsegment AS "who.segment" FROM customer""")
def json_records_round_trip(spark, folder):
    """Nested records come back as dotted columns."""
    path = scratch_path(spark, "json")
    nested = table(spark, folder, "customer").select("c_custkey", F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("money"),
        F.col("c_mktsegment").alias("segment")).alias("who"))
    sinks.write_json_records({"customers": nested}, path)
    schema = "c_custkey BIGINT, who STRUCT<name: STRING, money: STRUCT<balance: DOUBLE>, segment: STRING>"
    return readers.read_json_records(spark, f"{path}/customers", schema, lines=True)


@query("""
SELECT 'nations' AS "table", n_name AS name, n_nationkey AS key FROM nation
UNION ALL SELECT 'regions', r_name, r_regionkey FROM region""")
def json_document_round_trip(spark, folder):
    """Two small tables in one document, read back as named tables."""
    path = scratch_path(spark, "document")
    sinks.json_document({"nations": table(spark, folder, "nation"), "regions": table(spark, folder, "region")}, path)
    tables = readers.read_json_tables(spark, path)
    nations = tables["nations"].select(F.lit("nations").alias("table"), F.col("n_name").alias("name"),
                                       F.col("n_nationkey").cast("int").alias("key"))
    return nations.unionByName(tables["regions"].select(
        F.lit("regions").alias("table"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("key")))


@query("SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def parquet_by_segment(spark, folder):
    """Written as one folder per segment, read back whole."""
    path = scratch_path(spark, "parquet")
    sinks.write_table(table(spark, folder, "customer"), path, "parquet", partition_by="c_mktsegment")
    return readers.read_parquet_table(spark, path)


def _count_sql(columns: list[str], numeric: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS predictor, {numeric} AS numeric, count(DISTINCT {c}) AS levels, count({c}) AS present "
        "FROM lineitem" for c in columns)


@query(f"""
WITH counts AS ({_count_sql(["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                             "l_tax"], "true")} UNION ALL {_count_sql(["l_linestatus", "l_shipdate"], "false")})
SELECT predictor FROM counts WHERE levels > 1 AND levels <> present AND (numeric OR levels <= 20)""")
def usable_predictors(spark, folder):
    """What could explain the return flag: every column but the key that is neither constant nor unique."""
    chosen = prep.usable_predictors(table(spark, folder, "lineitem"), "l_returnflag", ids=["l_orderkey"], limit=9)
    return spark.createDataFrame([(c,) for c in chosen], "predictor string")
