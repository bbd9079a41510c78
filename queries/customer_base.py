"""BG/NBD and BG/BB: summaries, likelihoods and scores at given parameters, and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions import bgbb, bgnbd
from patronage.operators.summaries import bgbb_summary, bgnbd_summary, binary_periods, compress_histories
from patronage.plans import analyses
from patronage.plans import bgbb as bgbb_plan
from patronage.plans import bgnbd as bgnbd_plan
from patronage.scratch import scratch_path
from patronage.streaming import incremental
from queries import query, rounded, table
from queries.selection import RFM_SQL
from queries.shared import HISTORY_SQL, PERIODS_SQL, YEARS

# Published estimates of both models.
NBD = {"r": 0.243, "alpha": 4.414, "a": 0.793, "b": 2.426}
BB = {"alpha": 1.204, "beta": 0.750, "gamma": 0.657, "delta": 2.783}
NBD_FIT = bgnbd_plan.BGNBDFit(*NBD.values(), 0.0, True)
NBD_SQL = "p AS (SELECT 0.243::DOUBLE AS r, 4.414::DOUBLE AS al, 0.793::DOUBLE AS a, 2.426::DOUBLE AS b)"
BB_SQL = "p AS (SELECT 1.204::DOUBLE AS al, 0.750::DOUBLE AS be, 0.657::DOUBLE AS ga, 2.783::DOUBLE AS de)"


def history(spark, folder):
    return bgnbd_summary(table(spark, folder, "orders"), "o_custkey", "o_orderdate")


def periods(spark, folder):
    flags = binary_periods(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "year", YEARS)
    return bgbb_summary(flags, [f"p_{y}" for y in YEARS])


@query(f"WITH {HISTORY_SQL} SELECT o_custkey, x, round(tx, 6) AS tx, round(T, 6) AS T FROM history")
def bgnbd_histories(spark, folder):
    return rounded(history(spark, folder))


@query("""
SELECT o_custkey, CAST(count(*) - 1 AS BIGINT) AS x,
       round(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) / 30.4375, 6) AS tx,
       round(floor((epoch_us(TIMESTAMP '2000-06-30') - epoch_us(min(o_orderdate))) / 86400000000.0) / 30.4375, 6) AS T
FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-30' GROUP BY o_custkey""")
def bgnbd_histories_until_date(spark, folder):
    return rounded(bgnbd_summary(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "2000-06-30", "months",
                                 drop_after_end=True))


@query("""
SELECT x, tx, T, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT CAST(count(*) - 1 AS BIGINT) AS x, year(max(o_orderdate)) - year(min(o_orderdate)) AS tx,
         2001 - year(min(o_orderdate)) AS T FROM orders GROUP BY o_custkey) GROUP BY x, tx, T""")
def compressed_histories(spark, folder):
    by_year = table(spark, folder, "orders").groupBy("o_custkey").agg(
        (F.count("*") - 1).alias("x"),
        (F.year(F.max("o_orderdate")) - F.year(F.min("o_orderdate"))).cast("long").alias("tx"),
        (2001 - F.year(F.min("o_orderdate"))).cast("long").alias("T"))
    return compress_histories(by_year, ["x", "tx", "T"])


@query(f"""
WITH {HISTORY_SQL}, {NBD_SQL},
terms AS (SELECT o_custkey, x,
  lgamma(r + x) - lgamma(r) + r * ln(al) + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x) AS c,
  -(r + x) * ln(al + T) AS u, CASE WHEN x > 0 THEN ln(a) - ln(b + x - 1) - (r + x) * ln(al + tx) END AS v
  FROM history, p)
SELECT o_custkey, round(c + CASE WHEN x > 0 THEN greatest(u, v) + ln(exp(u - greatest(u, v)) + exp(v - greatest(u, v)))
                            ELSE u END, 6) AS log_likelihood FROM terms""")
def bgnbd_log_likelihood(spark, folder):
    return rounded(history(spark, folder).select("o_custkey", bgnbd.bgnbd_log_likelihood(
        "x", "tx", "T", **NBD).alias("log_likelihood")))


@query(f"""
WITH {HISTORY_SQL}, {NBD_SQL}
SELECT o_custkey, round(1 / (1 + CASE WHEN x > 0 THEN a / (b + x - 1)
       * exp((r + x) * (ln(al + T) - ln(al + tx))) ELSE 0 END), 6) AS probability_active FROM history, p""")
def bgnbd_probability_active(spark, folder):
    return rounded(history(spark, folder).select("o_custkey", bgnbd.probability_active(
        "x", "tx", "T", **NBD).alias("probability_active")))


@query(f"""
WITH {HISTORY_SQL}, {NBD_SQL},
h AS (SELECT *, 39.0 / (al + T + 39.0) AS z,
      1 / (1 + CASE WHEN x > 0 THEN a / (b + x - 1) * exp((r + x) * (ln(al + T) - ln(al + tx))) ELSE 0 END) AS alive
      FROM history, p WHERE T > 0),
s AS (SELECT o_custkey, any_value(r) AS r, any_value(a) AS a, any_value(b) AS b, any_value(x) AS x, any_value(z) AS z,
      any_value(alive) AS alive,
      sum(exp(lgamma(r + x + k) - lgamma(r + x) + lgamma(b + x + k) - lgamma(b + x) - lgamma(a + b + x - 1 + k)
              + lgamma(a + b + x - 1) - lgamma(k + 1) + k * ln(z))) AS f
      FROM h, generate_series(0, 3000) AS g(k) WHERE k < 60 + 60 * z / (1 - z) + 12 * x * z / (1 - z)
      GROUP BY o_custkey)
SELECT o_custkey, round(alive, 6) AS probability_active,
       round(greatest((a + b + x - 1) / (a - 1) * (1 - power(1 - z, r + x) * f), 0), 6) AS expected_if_active,
       round(greatest(alive * (a + b + x - 1) / (a - 1) * (1 - power(1 - z, r + x) * f), 0), 6)
         AS expected_future_purchases
FROM s""")
def bgnbd_expected_purchases(spark, folder):
    scored = bgnbd_plan.bgnbd_expected_purchases(history(spark, folder).where("T > 0"), 39.0, NBD_FIT)
    return rounded(scored.drop("x", "tx", "T"))


@query()
def bgnbd_fit_and_score(spark, folder):
    """One row: the fit on all customers, and the totals of its scores."""
    fit, scored = bgnbd_plan.score_bgnbd(history(spark, folder).where("T > 0"), horizon=39.0)
    return scored.agg(F.count("*").alias("customers"), F.avg("probability_active").alias("mean_active"),
                      F.sum("expected_future_purchases").alias("purchases_ahead")).select(
        *[F.lit(value).alias(name) for name, value in fit.to_dict().items()], "*")


@query()
def bgnbd_scores_from_log(spark, folder):
    orders = table(spark, folder, "orders")
    _, scored = analyses.bgnbd_from_log(orders, "o_custkey", "o_orderdate", 39.0, end="2001-12-31")
    return scored


@query(f"WITH {PERIODS_SQL} SELECT * FROM flags")
def binary_period_flags(spark, folder):
    return binary_periods(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "year", YEARS)


@query(f"WITH {PERIODS_SQL} SELECT * FROM summary")
def bgbb_histories(spark, folder):
    return periods(spark, folder).select("o_custkey", "n", "tx", "x")


PATHS_SQL = """
path AS (SELECT o_custkey, sum(power(pp, x) * power(1 - pp, tx - x + j) * qq * power(1 - qq, tx + j)) AS left_early
         FROM h, generate_series(0, 4) AS g(j) WHERE j < n - tx GROUP BY o_custkey)
"""


@query(f"""
WITH {PERIODS_SQL},
h AS (SELECT *, 0.15 + (o_custkey % 60) / 100.0::DOUBLE AS pp, (o_custkey % 30) / 100.0::DOUBLE AS qq FROM summary),
{PATHS_SQL},
l AS (SELECT h.*, power(pp, x) * power(1 - pp, n - x) * power(1 - qq, n) + coalesce(left_early, 0) AS likelihood
      FROM h LEFT JOIN path ON h.o_custkey = path.o_custkey)
SELECT o_custkey, round(likelihood, 9) AS history_probability,
       round(CASE WHEN likelihood = 0 THEN 0
             ELSE power(pp, x) * power(1 - pp, n - x) * power(1 - qq, n + 1) / likelihood END, 9) AS alive
FROM l""")
def bgbb_fixed_probabilities(spark, folder):
    h = periods(spark, folder).withColumns({
        "p": 0.15 + F.col("o_custkey") % 60 / 100.0, "q": F.col("o_custkey") % 30 / 100.0})
    return rounded(h.select(
        "o_custkey", bgbb.bgbb_history_probability("n", "tx", "x", "p", "q").alias("history_probability"),
        bgbb.bgbb_alive_fixed("n", "tx", "x", "p", "q").alias("alive")), 9)


BB_LIKELIHOOD_SQL = """
lb AS (SELECT o_custkey, any_value(n) AS n, any_value(tx) AS tx, any_value(x) AS x, any_value(al) AS al,
  any_value(be) AS be, any_value(ga) AS ga, any_value(de) AS de,
  ln(any_value(exp(lgamma(al + x) + lgamma(be + n - x) - lgamma(al + be + n) + lgamma(ga) + lgamma(de + n)
         - lgamma(ga + de + n) - lgamma(al) - lgamma(be) + lgamma(al + be) - lgamma(ga) - lgamma(de) + lgamma(ga + de)))
   + coalesce(sum(exp(lgamma(al + x) + lgamma(be + tx - x + j) - lgamma(al + be + tx + j) + lgamma(ga + 1)
         + lgamma(de + tx + j) - lgamma(ga + de + tx + j + 1) - lgamma(al) - lgamma(be) + lgamma(al + be)
         - lgamma(ga) - lgamma(de) + lgamma(ga + de))) FILTER (WHERE j < n - tx), 0)) AS ll
  FROM summary, p, generate_series(0, 4) AS g(j) GROUP BY o_custkey)
"""


@query(f"WITH {PERIODS_SQL}, {BB_SQL}, {BB_LIKELIHOOD_SQL} SELECT o_custkey, round(ll, 6) AS log_likelihood FROM lb")
def bgbb_log_likelihood(spark, folder):
    return rounded(periods(spark, folder).select("o_custkey", bgbb.bgbb_log_likelihood(
        "n", "tx", "x", **BB).alias("log_likelihood")))


@query(f"""
WITH {PERIODS_SQL}, {BB_SQL}, {BB_LIKELIHOOD_SQL}
SELECT o_custkey, round(exp(lgamma(al + x) + lgamma(be + n - x) - lgamma(al + be + n) - lgamma(al) - lgamma(be)
    + lgamma(al + be) + lgamma(de + n + 1) - lgamma(ga + de + n + 1) - lgamma(de) + lgamma(ga + de) - ll), 6)
  AS probability_alive FROM lb""")
def bgbb_probability_alive(spark, folder):
    return rounded(periods(spark, folder).select("o_custkey", bgbb.bgbb_probability_alive(
        "n", "tx", "x", **BB).alias("probability_alive")))


@query(f"""
WITH {PERIODS_SQL}, {BB_SQL}, {BB_LIKELIHOOD_SQL}
SELECT o_custkey, round(sum(exp(lgamma(al + x + 1) + lgamma(be + n - x) - lgamma(al + be + n + 1) - lgamma(al)
    - lgamma(be) + lgamma(al + be) + lgamma(de + n + k) - lgamma(ga + de + n + k) - lgamma(de) + lgamma(ga + de)
    - ll)), 6) AS expected_future_purchases
FROM lb, generate_series(1, 5) AS g(k) GROUP BY o_custkey""")
def bgbb_expected_purchases(spark, folder):
    return rounded(periods(spark, folder).select("o_custkey", bgbb.bgbb_expected_purchases(
        "n", "tx", "x", F.lit(5), **BB).alias("expected_future_purchases")))


@query()
def bgbb_fit_and_score(spark, folder):
    """One row: the fit on all customers, and the totals of its scores."""
    fit, scored = bgbb_plan.score_bgbb(periods(spark, folder), future_periods=5)
    return scored.agg(F.count("*").alias("customers"), F.avg("probability_alive").alias("mean_alive"),
                      F.sum("expected_future_purchases").alias("purchases_ahead")).select(
        *[F.lit(value).alias(name) for name, value in fit.to_dict().items()], "*")


@query(f"""
WITH {RFM_SQL}
SELECT o_custkey, last_purchase, purchase_count, round(monetary_average, 6) AS monetary_average,
       round(monetary_total, 6) AS monetary_total, recency_days, round(frequency_per_month, 6) AS frequency_per_month
FROM rfm""")
def streamed_rfm_inputs(spark, folder):
    """The log read as a stream, its totals kept per customer, and the RFM inputs of the last state."""
    schema = table(spark, folder, "orders").schema
    # The glob makes one file a stream source.
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    out = scratch_path(spark, "totals")
    incremental.stream_totals(orders, "o_custkey", "o_orderdate", "o_totalprice", out).awaitTermination()
    totals = incremental.current_totals(incremental.read_updates(spark, out), "o_custkey")
    return rounded(incremental.rfm_now(totals, "o_custkey"))
