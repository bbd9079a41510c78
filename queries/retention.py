"""Subscription cohorts: customers by the year of their first order, gone after their last."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions import subscription
from patronage.operators.summaries import survivor_curve
from patronage.plans import contractual
from queries import query, rounded, table

COHORT_SQL = """
life AS (SELECT o_custkey, CAST(year(min(o_orderdate)) AS INTEGER) AS cohort,
                least(year(max(o_orderdate)), 2000) - year(min(o_orderdate)) AS last_period
         FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY o_custkey),
span AS (SELECT cohort, k AS period FROM (SELECT DISTINCT cohort FROM life), generate_series(0, 5) AS g(k)
         WHERE k <= 2000 - cohort),
curve AS (SELECT s.cohort, CAST(s.period AS INTEGER) AS period,
                 CAST((SELECT count(*) FROM life l WHERE l.cohort = s.cohort AND l.last_period >= s.period) AS BIGINT)
                   AS survivors
          FROM span s)
"""


def curve(spark, folder):
    orders = table(spark, folder, "orders").where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz"))
    life = orders.groupBy("o_custkey").agg(
        F.year(F.min("o_orderdate")).alias("cohort"), F.year(F.max("o_orderdate")).alias("last_year"))
    return survivor_curve(life.select("cohort", (F.col("last_year") - F.col("cohort")).alias("last_period"),
                                      (2000 - F.col("cohort")).alias("horizon")),
                          "cohort", "last_period", "horizon")


@query(f"WITH {COHORT_SQL} SELECT * FROM curve")
def survivor_curves(spark, folder):
    return curve(spark, folder)


@query(f"""
WITH {COHORT_SQL}
SELECT cohort, list(survivors::DOUBLE ORDER BY period)::VARCHAR AS survivors,
       CASE WHEN count(*) < 3 THEN 'periods must be consecutive whole numbers that begin at 0' END AS invalid_reason
FROM curve GROUP BY cohort""")
def prepared_survivors(spark, folder):
    """Late cohorts have too few periods and are named, not dropped."""
    checked = contractual.prepare_survivors(curve(spark, folder), "cohort", "period", "survivors", "null")
    text = F.concat(F.lit("["), F.array_join(F.transform("survivors", lambda v: v.cast("string")), ", "), F.lit("]"))
    return checked.select("cohort", text.alias("survivors"), "invalid_reason")


@query("""
SELECT l_orderkey, l_linenumber,
  round(exp(lgamma(0.668 + l_tax) + lgamma(3.806 + l_quantity) - lgamma(4.474 + l_tax + l_quantity)
    - lgamma(0.668 + l_tax) - lgamma(3.806) + lgamma(4.474 + l_tax)), 6) AS survival,
  round((3.806 + l_quantity - 1) / (4.474 + l_tax + l_quantity - 1), 6) AS retention,
  round(exp(lgamma(1.668 + l_tax) + lgamma(3.806 + l_quantity - 1) - lgamma(4.474 + l_tax + l_quantity)
    - lgamma(0.668 + l_tax) - lgamma(3.806) + lgamma(4.474 + l_tax)), 6) AS duration
FROM lineitem""")
def sbg_functions(spark, folder):
    """Quantities serve as periods, and the tax shifts alpha, so every row asks something else."""
    alpha, beta, t = 0.668 + F.col("l_tax"), F.lit(3.806), F.col("l_quantity")
    return rounded(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", subscription.sbg_survival(t, alpha, beta).alias("survival"),
        subscription.sbg_retention(t, alpha, beta).alias("retention"),
        subscription.sbg_duration_probability(t, alpha, beta).alias("duration")))


# Known parameters of a cohort, applied to all of them.
GIVEN = (0.668, 3.806)
GIVEN_SQL = f"""
chance AS (
  SELECT cohort, CAST(period AS INTEGER) AS period, CASE WHEN period > 0 THEN ({GIVEN[1]} + period - 1) / ({sum(GIVEN)} + period - 1) END AS r,
         exp(lgamma({GIVEN[1]} + period) - lgamma({sum(GIVEN)} + period) + lgamma({sum(GIVEN)}) - lgamma({GIVEN[1]})) AS s
  FROM (SELECT cohort, unnest(generate_series(0, 20)) AS period FROM curve GROUP BY cohort HAVING count(*) >= 3)),
forecast AS (
  SELECT f.cohort, f.period, c.survivors / z.survivors AS actual_survival, s AS predicted_survival,
         r AS predicted_retention, s * z.survivors AS predicted_survivors
  FROM chance f JOIN curve z ON z.cohort = f.cohort AND z.period = 0
  LEFT JOIN curve c ON c.cohort = f.cohort AND c.period = f.period)
"""


def given(spark, folder):
    return contractual.sbg_forecast(curve(spark, folder), "cohort", "period", "survivors", 20, "null", GIVEN)


@query(f"""
WITH {COHORT_SQL}, {GIVEN_SQL}
SELECT cohort, period, round(actual_survival, 6) AS actual_survival, round(predicted_survival, 6) AS predicted_survival,
       round(predicted_retention, 6) AS predicted_retention, round(predicted_survivors, 5) AS predicted_survivors
FROM forecast""")
def sbg_forecasts_at_given(spark, folder):
    out = given(spark, folder).forecast
    return rounded(out.withColumn("predicted_survivors", F.round("predicted_survivors", 5)))


@query(f"""
WITH {COHORT_SQL}, {GIVEN_SQL}
SELECT cohort, period, 'actual_survival' AS series, round(actual_survival, 6) AS survival FROM forecast
UNION ALL SELECT cohort, period, 'predicted_survival', round(predicted_survival, 6) FROM forecast""")
def survival_series_at_given(spark, folder):
    return rounded(contractual.survival_long(given(spark, folder).forecast, "cohort"))


@query(f"""
WITH {COHORT_SQL}, {GIVEN_SQL},
seen AS (SELECT cohort, sum(survivors) / first(survivors ORDER BY period) AS bound, count(*) < 3 AS short FROM curve
         GROUP BY cohort)
SELECT s.cohort, round(any_value(bound), 6) AS observed_expected_lifetime_lower_bound,
       round(CASE WHEN NOT any_value(short) THEN {GIVEN[0] / sum(GIVEN)} END, 6) AS mean_defection_probability,
       round(sum(predicted_survival), 6) AS forecast_expected_lifetime
FROM seen s LEFT JOIN forecast f ON f.cohort = s.cohort GROUP BY s.cohort""")
def sbg_lifetimes_at_given(spark, folder):
    return rounded(given(spark, folder).parameters.select(
        "cohort", "observed_expected_lifetime_lower_bound", "mean_defection_probability", "forecast_expected_lifetime"))


# The best likelihood by a grid that follows the best cell and shrinks around it, in logarithms of alpha and beta.
@query(f"""
WITH RECURSIVE {COHORT_SQL},
step AS (SELECT a.cohort, a.period AS k, a.survivors AS s0, b.survivors AS s1
         FROM curve a JOIN curve b ON b.cohort = a.cohort AND b.period = a.period + 1),
able AS (SELECT cohort FROM step GROUP BY cohort HAVING count(*) >= 2),
cell AS (SELECT i / 6.0::DOUBLE AS u, j / 6.0::DOUBLE AS v FROM generate_series(-6, 6) a(i), generate_series(-6, 6) b(j)),
zoom AS (
  SELECT cohort, 0 AS level, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS ll FROM able
  UNION ALL
  SELECT cohort, level + 1, arg_max(x, ll), arg_max(y, ll), max(ll) FROM (
    SELECT z.cohort, level, least(greatest(z.x + u * 10 * power(0.6, level), {{low}}), {{high}}) AS x,
           least(greatest(z.y + v * 10 * power(0.6, level), {{low}}), {{high}}) AS y,
           sum((s0 - s1) * least(greatest(z.x + u * 10 * power(0.6, level), {{low}}), {{high}})
               + s1 * ln(exp(least(greatest(z.y + v * 10 * power(0.6, level), {{low}}), {{high}})) + k)
               - s0 * ln(exp(least(greatest(z.x + u * 10 * power(0.6, level), {{low}}), {{high}}))
                         + exp(least(greatest(z.y + v * 10 * power(0.6, level), {{low}}), {{high}})) + k)) AS ll
    FROM zoom z JOIN step USING (cohort), cell WHERE level < 45 GROUP BY z.cohort, level, z.x, z.y, u, v)
  GROUP BY cohort, level)
SELECT cohort, round(max(ll), 4) AS log_likelihood FROM zoom WHERE level = 45 GROUP BY cohort""".replace(
    "{low}", str(-contractual.LOG_BOUND)).replace("{high}", str(contractual.LOG_BOUND)))
def sbg_best_likelihoods(spark, folder):
    fits = contractual.fit_sbg(curve(spark, folder), "cohort", "period", "survivors", "null")
    return fits.where("invalid_reason is null").select("cohort", F.round("log_likelihood", 4).alias("log_likelihood"))


@query()
def sbg_fits(spark, folder):
    return contractual.fit_sbg(curve(spark, folder), "cohort", "period", "survivors", "null")


@query()
def sbg_forecasts(spark, folder):
    return contractual.sbg_forecast(curve(spark, folder), "cohort", "period", "survivors", 20, "null").forecast


@query()
def sbg_parameters(spark, folder):
    return contractual.sbg_forecast(curve(spark, folder), "cohort", "period", "survivors", 20, "null").parameters


@query()
def survival_series(spark, folder):
    forecast = contractual.sbg_forecast(curve(spark, folder), "cohort", "period", "survivors", 20, "null").forecast
    return contractual.survival_long(forecast, "cohort")
