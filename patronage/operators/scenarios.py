"""Lifetime value and budgets for tables of customers, segments or what-if rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import as_column, guarded, invalid_reason
from patronage.functions.value import (
    ceiling_rate,
    clv_finite,
    clv_growth,
    clv_infinite,
    clv_retention_elasticity,
    clv_timed,
    curve_steepness,
    prospect_value,
    value_rules,
)
from patronage.errors import InputProblem

MODELS = ("infinite", "finite", "growth", "timed")

# Budgets are sought up to 10 times today's spend, or to where a curve has reached all
# but 1e-5 of its ceiling.
SPEND_FACTOR = 10
CEILING_GAP = 1e-5
# Steps that take y + ln y = c to the last digit for any c.
NEWTON_STEPS = 12


def clv_summary(df: DataFrame, margin, retention, discount, acquisition_cost=0.0, model: str = "infinite",
                periods=None, growth=None, first=None, last=None, on_invalid: str = "null") -> DataFrame:
    """Adds lifetime value, net value, margin multiple and elasticities to every row.

    ``model`` picks which value ``selected_model_clv`` holds; the others take ``periods``, ``growth``
    or ``first`` and ``last``. ``invalid_reason`` names the first broken rule.
    """
    if model not in MODELS:
        raise InputProblem(f"Unknown model {model!r}; use one of {', '.join(MODELS)}.")
    m, cost = as_column(margin).cast("double"), as_column(acquisition_cost).cast("double")
    base = clv_infinite(margin, retention, discount, on_invalid)
    chosen = {
        "infinite": lambda: base,
        "finite": lambda: clv_finite(margin, retention, discount, periods, on_invalid),
        "growth": lambda: clv_growth(margin, retention, discount, growth, on_invalid),
        "timed": lambda: clv_timed(margin, retention, discount, first, last, on_invalid),
    }[model]()
    converges = 1 + as_column(discount).cast("double") - as_column(retention).cast("double") > 0
    rules = [*value_rules(margin, retention, discount), (converges, "the endless sum does not converge")]
    return df.withColumns({"clv": base, "selected_model_clv": chosen}).withColumns({
        "acquisition_cost": cost,
        "net_value": F.col("clv") - cost,
        "margin_multiple": F.when(m == 0, F.col("clv") * 0).otherwise(F.col("clv") / F.when(m != 0, m)),
        "margin_elasticity": F.when(F.col("clv").isNotNull(), F.lit(1.0)),
        "retention_elasticity": F.when(
            F.col("clv").isNotNull(), clv_retention_elasticity(retention, discount, on_invalid)),
        "selected_net_value": F.col("selected_model_clv") - cost,
        "invalid_reason": invalid_reason(rules),
    })


def _plus_log(total: Column) -> Column:
    """The y > 0 with y + ln y = total (Lambert's W of e^total), by Newton's method within the row.

    After one step the iterates rise to the solution, and digits double from step to step.
    """
    start = F.when(total > 1, total).otherwise(F.exp(total))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start,
                       lambda y, _: y * (1 + total - F.log(y)) / (1 + y))


def optimize_budgets(df: DataFrame, acquisition_spend, acquisition_rate, acquisition_ceiling, retention_spend,
                     retention_rate, retention_ceiling, margin, discount, on_invalid: str = "null") -> DataFrame:
    """Adds the spend pair that maximises the value of a prospect, per row.

    With a(A) and r(R) the two ceiling curves, value = a(A)·(m + V(R)) − A, V(R) = (m·r − R)/(1+d−r).
    So R maximises V alone: V' has the sign of r'(R)·(m(1+d) − R) − (1+d−r(R)), which only falls while
    R < m(1+d) and is negative beyond. With r' = beta·(ceiling − r), its zero is
    R = m(1+d) − (y+1)/beta, where y + ln y = beta·m(1+d) − 1 + ln((1+d−ceiling)/ceiling). Given V, the best
    A solves a'(A)·(m+V) = 1, again in closed form. Both are exact maxima, held within the search box. A
    discount of (ceiling − 1) or less would let the value grow without bound, and is reported as invalid.
    """
    a0, ra, ca, r0, rr, cr, m, d = (as_column(c).cast("double") for c in (
        acquisition_spend, acquisition_rate, acquisition_ceiling, retention_spend, retention_rate,
        retention_ceiling, margin, discount))
    rules = [
        ((a0 > 0) & (ra > 0) & (ra < ca) & (ca <= 1), "acquisition: need spend > 0 and 0 < rate < ceiling <= 1"),
        ((r0 > 0) & (rr > 0) & (rr < cr) & (cr <= 1), "retention: need spend > 0 and 0 < rate < ceiling <= 1"),
        (1 + d - cr > 0, "discount must exceed the retention ceiling less 1"),
        (m.isNotNull() & ~F.isnan(m), "margin is missing"),
    ]
    reason = invalid_reason(rules)
    good = reason.isNull()
    ba = F.when(good, curve_steepness(a0, ra, ca))
    br = F.when(good, curve_steepness(r0, rr, cr))
    out = df.withColumns({"acquisition_beta": ba, "retention_beta": br})
    ba, br = F.col("acquisition_beta"), F.col("retention_beta")
    reach = -math.log(CEILING_GAP)
    top_a = F.greatest(a0 * SPEND_FACTOR, reach / ba)
    top_r = F.greatest(r0 * SPEND_FACTOR, reach / br)

    reached = m * (1 + d)
    spread = F.when(good, F.log(F.when(good, (1 + d - cr) / cr)))
    out = out.withColumn("_y", F.when(cr * br * m > 1, _plus_log(br * reached - 1 + spread)))
    # Without a rise at zero spend there is no inner zero (least and greatest would skip the NULL).
    inner = F.greatest(F.lit(0.0), F.least(top_r, reached - (F.col("_y") + 1) / br))
    best_r = F.when(good, F.when(F.col("_y").isNull(), F.lit(0.0)).otherwise(inner))
    out = out.withColumn("optimal_retention_spend", best_r)
    R = F.col("optimal_retention_spend")
    r = ceiling_rate(R, cr, br)
    worth = m + (m * r - R) / (1 + d - r)
    pull = F.when(worth > 0, ca * ba * worth)
    best_a = F.when(good, F.when(pull > 1, F.least(top_a, F.log(F.when(pull > 1, pull)) / ba)).otherwise(F.lit(0.0)))
    out = out.withColumn("optimal_acquisition_spend", best_a)
    now = prospect_value(a0, r0, ca, cr, ba, br, m, d)
    then = prospect_value(F.col("optimal_acquisition_spend"), R, ca, cr, ba, br, m, d)
    out = out.withColumns({"_now": F.when(good, now), "_then": F.when(good, then)})
    was, will = F.col("_now.prospect_value"), F.col("_then.prospect_value")
    return out.withColumns({
        "current_value": was,
        "optimal_value": will,
        "optimal_acquisition_rate": F.col("_then.acquisition_rate"),
        "optimal_retention_rate": F.col("_then.retention_rate"),
        "improvement_pct": (will / F.when(was != 0, was) - 1) * 100,
        "invalid_reason": guarded(F.lit(None).cast("string"), rules, "error") if on_invalid == "error" else reason,
    }).drop("_now", "_then", "_y")
