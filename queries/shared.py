"""Tables several queries start from, as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries import table

CUTOFF = "2001-01-01"


def response_table(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer: orders before 2001 as predictors, any order from 2001 on as the response."""
    orders = table(spark, folder, "orders")
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    before = F.col("o_orderdate") < cutoff
    per_customer = orders.groupBy("o_custkey").agg(
        F.count_if(before).alias("purchases"),
        F.sum(F.when(before, F.col("o_totalprice"))).alias("spend"),
        F.max(F.when(before, F.col("o_orderdate"))).alias("last_before"),
        F.max(F.when(~before, 1).otherwise(0)).alias("response"))
    return table(spark, folder, "customer").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey",
        F.coalesce("purchases", F.lit(0)).cast("long").alias("purchases"),
        F.when(F.col("purchases") > 0, F.col("spend") / F.col("purchases")).alias("average_amount"),
        F.extract(F.lit("DAY"), cutoff - F.col("last_before")).alias("recency_days"),
        F.coalesce("response", F.lit(0)).alias("response"))


RESPONSE_SQL = f"""
feature AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS purchases,
         sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS spend,
         max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '{CUTOFF}') AS last_before,
         max(CASE WHEN o_orderdate >= TIMESTAMP '{CUTOFF}' THEN 1 ELSE 0 END) AS response
  FROM orders GROUP BY o_custkey),
response_table AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey,
         coalesce(purchases, 0) AS purchases,
         CASE WHEN purchases > 0 THEN spend / purchases END AS average_amount,
         CAST(floor((epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(last_before)) / 86400000000.0) AS INTEGER)
           AS recency_days,
         coalesce(response, 0) AS response
  FROM customer LEFT JOIN feature ON c_custkey = o_custkey)
"""

# BG/NBD inputs of every customer in weeks, up to the last order.
HISTORY_SQL = """
ends AS (SELECT max(o_orderdate) AS last_day FROM orders),
history AS (
  SELECT o_custkey, CAST(count(*) - 1 AS BIGINT) AS x,
         floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) / 7.0 AS tx,
         floor((epoch_us(any_value(last_day)) - epoch_us(min(o_orderdate))) / 86400000000.0) / 7.0 AS T
  FROM orders, ends GROUP BY o_custkey)
"""

YEARS = ["1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-01-01"]

# Ordered or not in each of five years, and the BG/BB summary of it.
PERIODS_SQL = """
flags AS (
  SELECT o_custkey, """ + ", ".join(
    f"CAST(max(CASE WHEN year(o_orderdate) = {y[:4]} THEN 1 ELSE 0 END) AS INTEGER) AS \"p_{y}\""
    for y in YEARS) + """
  FROM orders GROUP BY o_custkey),
bought AS (
  SELECT DISTINCT o_custkey, year(o_orderdate) - 1995 AS period FROM orders
  WHERE year(o_orderdate) BETWEEN 1996 AND 2000),
summary AS (
  SELECT f.o_custkey, 5 AS n, CAST(coalesce(max(period), 0) AS INTEGER) AS tx, CAST(count(period) AS INTEGER) AS x
  FROM flags f LEFT JOIN bought b ON f.o_custkey = b.o_custkey GROUP BY f.o_custkey)
"""
