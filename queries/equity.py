"""Customer counts, acquisitions and customer equity per market segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions import value
from patronage.operators.summaries import acquired_customers, active_customers_per_period
from patronage.plans import equity as plan
from queries import query, rounded, table

QUARTER_SQL = """
active AS (SELECT c_mktsegment, date_trunc('quarter', o_orderdate) AS quarter, count(DISTINCT o_custkey) AS customers
           FROM orders JOIN customer ON o_custkey = c_custkey
           WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1, 2),
span AS (SELECT c_mktsegment, CAST(k AS INTEGER) AS period,
                CAST(TIMESTAMP '1995-01-01' + INTERVAL 3 MONTH * k AS TIMESTAMP) AS quarter
         FROM (SELECT DISTINCT c_mktsegment FROM active), generate_series(0, 25) AS g(k)),
counts AS (SELECT s.c_mktsegment, s.period, s.quarter AS period_start, coalesce(customers, 0) AS customers
           FROM span s LEFT JOIN active a ON s.c_mktsegment = a.c_mktsegment AND s.quarter = a.quarter)
"""


def counts(spark, folder):
    log = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return active_customers_per_period(log, "o_custkey", "o_orderdate", "quarter", "c_mktsegment", "2001-07-01")


@query(f"WITH {QUARTER_SQL} SELECT * FROM counts")
def active_customers(spark, folder):
    return counts(spark, folder)


@query(f"""
WITH {QUARTER_SQL},
steps AS (SELECT *, lag(customers) OVER (PARTITION BY c_mktsegment ORDER BY period) AS before FROM counts)
SELECT c_mktsegment, period, period_start, customers, CASE WHEN customers - 0.9 * before >= -1e-8
       THEN round(greatest(customers - 0.9 * before, 0), 6) END AS acquired
FROM steps WHERE before IS NOT NULL""")
def acquired_per_period(spark, folder):
    """At 90 percent retention some quarters would need negative acquisitions: NULL, not clipped."""
    return rounded(acquired_customers(counts(spark, folder), "period", "customers", 0.9, "c_mktsegment", "null"))


@query("""
SELECT o_orderkey, round(1000 * g * exp(-b - g * t) / power(1 + exp(-b - g * t), 2), 6) AS acquired FROM (
  SELECT o_orderkey, date_diff('month', TIMESTAMP '1995-01-01', o_orderdate) AS t,
         -4.0 + (o_custkey % 9) / 4.0::DOUBLE AS b, 0.05 + (o_custkey % 7) / 20.0::DOUBLE AS g FROM orders)""")
def acquisition_curves(spark, folder):
    date, key = F.col("o_orderdate"), F.col("o_custkey")
    month = (F.year(date) - 1995) * 12 + F.month(date) - 1
    return rounded(table(spark, folder, "orders").select("o_orderkey", value.acquisition_curve(
        month, F.lit(1000.0), -4.0 + key % 9 / 4.0, 0.05 + key % 7 / 20.0).alias("acquired")))


def _valued(spark, folder):
    return plan.customer_equity(
        counts(spark, folder), "c_mktsegment", "period", "customers", acquisition_cost=120.0, margin=100.0,
        retention=0.3, discount=0.1, tax_rate=0.38, forecast_periods=100, periods_per_year=4, on_invalid="null")


# A known acquisition curve, applied to all segments.
GIVEN = (900.0, -2.5, 0.15)
TERMS = {"acquisition_cost": 120.0, "margin": 100.0, "retention": 0.3, "discount": 0.1, "tax_rate": 0.38,
         "forecast_periods": 40, "periods_per_year": 4}
BELL = ("{a} * {g} * exp(-({b}) - {g} * {t}) / power(1 + exp(-({b}) - {g} * {t}), 2)").format(
    a=GIVEN[0], b=GIVEN[1], g=GIVEN[2], t="{t}")
EQUITY_SQL = f"""
step AS (SELECT *, lag(customers) OVER (PARTITION BY c_mktsegment ORDER BY period) AS before FROM counts),
good AS (SELECT c_mktsegment, max(period) AS last_t, arg_max(customers, period) AS last_n,
                coalesce(min(customers - 0.3 * before) >= -1e-8, true) AS usable,
                coalesce(min(customers - 0.3 * power(1.01, 0.25) * before) >= -1e-8, true) AS reachable
         FROM step GROUP BY c_mktsegment),
future AS (SELECT c_mktsegment, i AS ahead, last_t + i AS period, {BELL.format(t="(last_t + i)")} AS n
           FROM good, generate_series(1, 40) AS g(i) WHERE usable),
discounted AS (SELECT c_mktsegment, sum(n / power(1.1, ahead)) AS n FROM future GROUP BY c_mktsegment),
worth AS (SELECT *, last_n * 37.5 AS now, 37.5 - 120 AS net FROM good LEFT JOIN discounted USING (c_mktsegment))
"""


def _at_given(spark, folder):
    return plan.customer_equity(counts(spark, folder), "c_mktsegment", "period", "customers", **TERMS,
                                on_invalid="null", given=GIVEN)


@query(f"""
WITH {QUARTER_SQL}, {EQUITY_SQL}
SELECT c_mktsegment, round(CASE WHEN usable THEN 37.5 END, 6) AS clv,
       round(CASE WHEN usable THEN now END, 4) AS current_customer_value, round(net * n, 4) AS future_customer_value,
       round(now + net * n, 4) AS pre_tax_customer_equity, round((now + net * n) * 0.62, 4) AS customer_equity FROM worth""")
def customer_equity_at_given(spark, folder):
    out = _at_given(spark, folder).summary
    money = ("current_customer_value", "future_customer_value", "pre_tax_customer_equity", "customer_equity")
    return out.select("c_mktsegment", F.round("clv", 6).alias("clv"), *[F.round(c, 4).alias(c) for c in money])


@query(f"""
WITH {QUARTER_SQL}, {EQUITY_SQL}
SELECT s.c_mktsegment, CAST(s.period AS DOUBLE) AS period, round(greatest(customers - 0.3 * before, 0), 6) AS customers,
       'Observed' AS series FROM step s JOIN good USING (c_mktsegment) WHERE usable AND before IS NOT NULL
UNION ALL SELECT s.c_mktsegment, s.period, round({BELL.format(t="s.period")}, 6), 'Fitted' FROM step s
  JOIN good USING (c_mktsegment) WHERE usable AND before IS NOT NULL
UNION ALL SELECT c_mktsegment, period, round(n, 6), 'Forecast' FROM future""")
def customer_equity_series_at_given(spark, folder):
    return rounded(_at_given(spark, folder).series("c_mktsegment"))


@query(f"""
WITH {QUARTER_SQL}, {EQUITY_SQL},
level AS (SELECT c_mktsegment, reachable, (now + net * n) * 0.62 AS base,
                 (last_n * 37.875 + (37.875 - 120) * n) * 0.62 AS margin,
                 (now + (37.5 - 118.8) * n) * 0.62 AS cost, 0.3 * power(1.01, 0.25) AS r, last_n, n FROM worth WHERE usable),
driver AS (SELECT c_mktsegment, base, 'margin increase' AS driver, margin AS revised FROM level
           UNION ALL SELECT c_mktsegment, base, 'acquisition cost reduction', cost FROM level
           UNION ALL SELECT c_mktsegment, base, 'retention increase', CASE WHEN reachable THEN
             (last_n * (100 * r / (1.1 - r)) + (100 * r / (1.1 - r) - 120) * n) * 0.62 END FROM level)
SELECT c_mktsegment, driver, round(base, 4) AS base_customer_equity, round(revised, 4) AS revised_customer_equity,
       round((revised - base) / base / 0.01, 4) AS elasticity FROM driver""")
def customer_equity_elasticities_at_given(spark, folder):
    out = _at_given(spark, folder).elasticities
    return out.select("c_mktsegment", "driver", *[
        F.round(c, 4).alias(c) for c in ("base_customer_equity", "revised_customer_equity", "elasticity")])


@query()
def acquisition_curve_fits(spark, folder):
    acquired = acquired_customers(counts(spark, folder), "period", "customers", 0.3, "c_mktsegment", "null")
    return plan.fit_acquisition_curve(acquired, "c_mktsegment", "period", "acquired")


@query()
def customer_equity_summary(spark, folder):
    return _valued(spark, folder).summary


@query()
def customer_equity_series(spark, folder):
    return _valued(spark, folder).series("c_mktsegment")


@query()
def customer_equity_elasticities(spark, folder):
    return _valued(spark, folder).elasticities
