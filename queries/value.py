"""Lifetime value, spend curves, budgets and special functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions import special
from patronage.functions import value as v
from patronage.operators import scenarios
from patronage.operators.summaries import bgnbd_summary
from queries import query, rounded, table
from queries.shared import HISTORY_SQL

# Scenario rows: every customer's balance as margin (some are negative), with rates that vary by key.
SCENARIO_SQL = """
scenario AS (
  SELECT c_custkey, c_acctbal AS margin, (52 + c_custkey % 49) / 101.0::DOUBLE AS retention,
         (c_nationkey % 7) / 50.0::DOUBLE AS discount, 100.0::DOUBLE + c_nationkey AS cost,
         CAST(c_custkey % 13 AS INTEGER) AS periods, (c_custkey % 5) / 40.0::DOUBLE AS growth,
         CAST(c_custkey % 4 AS INTEGER) AS first, CAST(c_custkey % 4 + c_custkey % 6 AS INTEGER) AS last
  FROM customer)
"""
GOOD = "margin >= 0 AND retention BETWEEN 0 AND 1 AND discount > -1"


def scenario(spark, folder):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("margin"), ((52 + key % 49) / 101.0).alias("retention"),
        (nation % 7 / 50.0).alias("discount"), (100.0 + nation).alias("cost"),
        (key % 13).cast("int").alias("periods"), (key % 5 / 40.0).alias("growth"),
        (key % 4).cast("int").alias("first"), (key % 4 + key % 6).cast("int").alias("last"))


@query(f"""
WITH {SCENARIO_SQL}
SELECT c_custkey, CASE WHEN {GOOD} THEN round(margin * retention / (1 + discount - retention), 6) END AS clv
FROM scenario""")
def clv_infinite(spark, folder):
    return rounded(scenario(spark, folder).select(
        "c_custkey", v.clv_infinite("margin", "retention", "discount").alias("clv")))


@query(f"""
WITH {SCENARIO_SQL}
SELECT c_custkey, any_value(CASE WHEN {GOOD} THEN 1 END) * round(coalesce(sum(
         margin * power(retention / (1 + discount), k)) FILTER (WHERE k <= periods), 0), 6) AS clv
FROM scenario, generate_series(1, 13) AS g(k) GROUP BY c_custkey""")
def clv_finite(spark, folder):
    return rounded(scenario(spark, folder).select(
        "c_custkey", v.clv_finite("margin", "retention", "discount", "periods").alias("clv")))


@query(f"""
WITH {SCENARIO_SQL}
SELECT c_custkey, CASE WHEN {GOOD} AND 1 + discount - retention * (1 + growth) > 0
       THEN round(margin * retention / (1 + discount - retention * (1 + growth)), 6) END AS clv FROM scenario""")
def clv_growth(spark, folder):
    return rounded(scenario(spark, folder).select(
        "c_custkey", v.clv_growth("margin", "retention", "discount", "growth").alias("clv")))


@query(f"""
WITH {SCENARIO_SQL}
SELECT c_custkey, any_value(CASE WHEN {GOOD} THEN 1 END) * round(sum(
         margin * power(retention / (1 + discount), k)) FILTER (WHERE k BETWEEN first AND last), 6) AS clv
FROM scenario, generate_series(0, 9) AS g(k) GROUP BY c_custkey""")
def clv_timed(spark, folder):
    return rounded(scenario(spark, folder).select(
        "c_custkey", v.clv_timed("margin", "retention", "discount", "first", "last").alias("clv")))


@query(f"""
WITH {SCENARIO_SQL}
SELECT c_custkey, round(1 + retention / (1 + discount - retention), 6) AS elasticity FROM scenario""")
def clv_retention_elasticity(spark, folder):
    return rounded(scenario(spark, folder).select(
        "c_custkey", v.clv_retention_elasticity("retention", "discount").alias("elasticity")))


@query(f"""
WITH {SCENARIO_SQL},
value AS (SELECT *, CASE WHEN {GOOD} THEN margin * retention / (1 + discount - retention) END AS clv,
  CASE WHEN {GOOD} AND 1 + discount - retention * (1 + growth) > 0
       THEN margin * retention / (1 + discount - retention * (1 + growth)) END AS selected FROM scenario)
SELECT c_custkey, round(clv, 6) AS clv, round(selected, 6) AS selected_model_clv, cost AS acquisition_cost,
       round(clv - cost, 6) AS net_value,
       round(CASE WHEN margin = 0 THEN 0 ELSE clv / margin END, 6) AS margin_multiple,
       CASE WHEN clv IS NOT NULL THEN 1.0::DOUBLE END AS margin_elasticity,
       CASE WHEN clv IS NOT NULL THEN round(1 + retention / (1 + discount - retention), 6) END AS retention_elasticity,
       round(selected - cost, 6) AS selected_net_value,
       CASE WHEN margin < 0 THEN 'margin must not be negative' END AS invalid_reason
FROM value""")
def clv_summary(spark, folder):
    out = scenarios.clv_summary(scenario(spark, folder), "margin", "retention", "discount", "cost",
                                model="growth", growth="growth")
    return rounded(out.drop("margin", "retention", "discount", "cost", "periods", "growth", "first", "last"))


# One budget question per customer; some rows are impossible on purpose (rate above its ceiling).
BUDGET_SQL = """
budget AS (
  SELECT c_custkey, 5.0::DOUBLE + c_nationkey AS a_spend, 0.05 + (c_custkey % 40) / 100.0::DOUBLE AS a_rate,
         0.42::DOUBLE AS a_top, 4.0::DOUBLE + c_custkey % 17 AS r_spend, 0.3 + (c_custkey % 11) / 25.0::DOUBLE AS r_rate,
         0.75::DOUBLE AS r_top, abs(c_acctbal) / 39 AS margin, 0.05 + (c_nationkey % 5) / 50.0::DOUBLE AS discount
  FROM customer),
curve AS (
  SELECT *, a_rate < a_top AND r_rate < r_top AS good,
         CASE WHEN a_rate < a_top THEN -ln((a_top - a_rate) / a_top) / a_spend END AS a_beta,
         CASE WHEN r_rate < r_top THEN -ln((r_top - r_rate) / r_top) / r_spend END AS r_beta
  FROM budget)
"""


def budget(spark, folder):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, folder, "customer").select(
        "c_custkey", (5.0 + nation).alias("a_spend"), (0.05 + key % 40 / 100.0).alias("a_rate"),
        F.lit(0.42).alias("a_top"), (4.0 + key % 17).alias("r_spend"), (0.3 + key % 11 / 25.0).alias("r_rate"),
        F.lit(0.75).alias("r_top"), (F.abs("c_acctbal") / 39).alias("margin"),
        (0.05 + nation % 5 / 50.0).alias("discount"))


@query(f"""
WITH {BUDGET_SQL}
SELECT c_custkey, round(a_beta, 6) AS a_beta, round(r_beta, 6) AS r_beta,
       round(a_top * (1 - exp(-a_beta * a_spend)), 6) AS a_fitted,
       round(r_top * (1 - exp(-r_beta * 2 * r_spend)), 6) AS r_doubled FROM curve""")
def spend_curves(spark, folder):
    b = budget(spark, folder).withColumns({
        "a_beta": v.curve_steepness("a_spend", "a_rate", "a_top"),
        "r_beta": v.curve_steepness("r_spend", "r_rate", "r_top")})
    return rounded(b.select(
        "c_custkey", "a_beta", "r_beta", v.ceiling_rate("a_spend", "a_top", "a_beta").alias("a_fitted"),
        v.ceiling_rate(F.col("r_spend") * 2, "r_top", "r_beta").alias("r_doubled")))


@query(f"""
WITH {BUDGET_SQL}
SELECT c_custkey, round(a_rate * ((margin - a_spend / a_rate)
         + (margin - r_spend / r_rate) * r_rate / (1 + discount - r_rate)), 6) AS prospect_value,
       round(a_rate, 6) AS acquisition_rate, round(r_rate, 6) AS retention_rate,
       round((margin - a_spend / a_rate) + (margin - r_spend / r_rate) * r_rate / (1 + discount - r_rate), 6)
         AS customer_value
FROM curve WHERE good""")
def prospect_value(spark, folder):
    b = budget(spark, folder).withColumns({
        "a_beta": v.curve_steepness("a_spend", "a_rate", "a_top"),
        "r_beta": v.curve_steepness("r_spend", "r_rate", "r_top")}).where("a_rate < a_top and r_rate < r_top")
    return rounded(b.select("c_custkey", v.prospect_value(
        "a_spend", "r_spend", "a_top", "r_top", "a_beta", "r_beta", "margin", "discount").alias("p")).select(
        "c_custkey", "p.*"))


@query(f"""
WITH RECURSIVE {BUDGET_SQL},
search AS (
  SELECT c_custkey, 0 AS step, 0.0::DOUBLE AS low,
         greatest(0.0, least(greatest(r_spend * 10, -ln(1e-5) / r_beta), margin * (1 + discount)))::DOUBLE AS high
  FROM curve WHERE good AND r_top * r_beta * margin > 1
  UNION ALL
  SELECT s.c_custkey, step + 1,
    CASE WHEN r_beta * r_top * exp(-r_beta * (low + high) / 2) * (margin * (1 + discount) - (low + high) / 2)
              > 1 + discount - r_top * (1 - exp(-r_beta * (low + high) / 2)) THEN (low + high) / 2 ELSE low END,
    CASE WHEN r_beta * r_top * exp(-r_beta * (low + high) / 2) * (margin * (1 + discount) - (low + high) / 2)
              > 1 + discount - r_top * (1 - exp(-r_beta * (low + high) / 2)) THEN high ELSE (low + high) / 2 END
  FROM search s JOIN curve c ON s.c_custkey = c.c_custkey WHERE step < 60),
best_r AS (
  SELECT c.*, CASE WHEN good THEN coalesce((low + high) / 2, 0) END AS R
  FROM curve c LEFT JOIN search s ON c.c_custkey = s.c_custkey AND step = 60),
worth AS (
  SELECT *, margin + (margin * r_top * (1 - exp(-r_beta * R)) - R)
                     / (1 + discount - r_top * (1 - exp(-r_beta * R))) AS w FROM best_r),
best_a AS (
  SELECT *, CASE WHEN good THEN CASE WHEN w > 0 AND a_top * a_beta * w > 1
     THEN least(greatest(a_spend * 10, -ln(1e-5) / a_beta), ln(a_top * a_beta * w) / a_beta) ELSE 0 END END AS A
  FROM worth)
SELECT c_custkey, round(A, 4) AS optimal_acquisition_spend, round(R, 4) AS optimal_retention_spend,
  round(a_rate * margin - a_spend + a_rate * (margin * r_rate - r_spend) / (1 + discount - r_rate), 6)
    * (CASE WHEN good THEN 1 END) AS current_value,
  round(a_top * (1 - exp(-a_beta * A)) * w - A, 6) AS optimal_value
FROM best_a""")
def optimal_budgets(spark, folder):
    out = scenarios.optimize_budgets(budget(spark, folder), "a_spend", "a_rate", "a_top", "r_spend", "r_rate",
                                     "r_top", "margin", "discount")
    return out.select(
        "c_custkey", (F.round("optimal_acquisition_spend", 4) + 0.0).alias("optimal_acquisition_spend"),
        (F.round("optimal_retention_spend", 4) + 0.0).alias("optimal_retention_spend"),
        (F.round("current_value", 6) + 0.0).alias("current_value"),
        (F.round("optimal_value", 6) + 0.0).alias("optimal_value"))


@query("""
SELECT l_orderkey, l_linenumber, round(lgamma(l_quantity + l_discount), 6) AS log_gamma_quantity,
       round(lgamma(0.01 + l_tax), 6) AS log_gamma_tax,
       round(lgamma(0.5 + l_discount) + lgamma(l_quantity) - lgamma(0.5 + l_discount + l_quantity), 6) AS log_beta,
       round(ln(exp(-l_quantity) + exp(-l_discount) + exp(l_tax)), 6) AS log_sum_exp
FROM lineitem""")
def log_gamma_functions(spark, folder):
    quantity, discount, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return rounded(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", special.log_gamma(quantity + discount).alias("log_gamma_quantity"),
        special.log_gamma(0.01 + tax).alias("log_gamma_tax"),
        special.log_beta(0.5 + discount, quantity).alias("log_beta"),
        special.log_sum_exp(F.array(-quantity, -discount, tax)).alias("log_sum_exp")))


@query("""
WITH arguments AS (
  SELECT c_custkey, 0.3 + (c_custkey % 9) / 2.0::DOUBLE AS a, 1.0 + (c_custkey % 5)::DOUBLE AS b,
         4.0 + (c_custkey % 7)::DOUBLE AS c, (c_custkey % 8) / 10.0::DOUBLE AS z FROM customer)
SELECT c_custkey, round(sum(exp(lgamma(a + k) - lgamma(a) + lgamma(b + k) - lgamma(b) - lgamma(c + k) + lgamma(c)
       - lgamma(k + 1)) * CASE WHEN k = 0 THEN 1 ELSE power(z, k) END), 6) AS hypergeometric
FROM arguments, generate_series(0, 250) AS g(k) GROUP BY c_custkey""")
def hypergeometric(spark, folder):
    key = F.col("c_custkey")
    return rounded(table(spark, folder, "customer").select("c_custkey", special.hyp2f1(
        0.3 + key % 9 / 2.0, 1.0 + (key % 5).cast("double"), 4.0 + (key % 7).cast("double"), key % 8 / 10.0,
    ).alias("hypergeometric")))


@query(f"""
WITH {HISTORY_SQL},
arguments AS (SELECT o_custkey, 0.3 + x AS a, 1 - 1e-6 * exp(-tx / 50) AS z FROM history)
SELECT o_custkey, round(ln((1 - power(1 - z, 1 - a)) / ((1 - a) * z)), 6) AS log_hypergeometric FROM arguments""")
def hypergeometric_near_one(spark, folder):
    """F(a, 1; 2; z) has a closed form; z comes as near to 1 as 1e-9."""
    history = bgnbd_summary(table(spark, folder, "orders"), "o_custkey", "o_orderdate")
    z = 1 - 1e-6 * F.exp(-F.col("tx") / 50)
    return rounded(history.select("o_custkey", F.log(special.hyp2f1(
        0.3 + F.col("x"), F.lit(1.0), F.lit(2.0), z)).alias("log_hypergeometric")))
