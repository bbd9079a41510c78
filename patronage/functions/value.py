"""Lifetime value, response targeting and spend curves as column expressions.

Every function takes columns, column names or numbers, so the inputs may differ by row.
``on_invalid`` says what a row outside the valid range gives: NULL, or an error when the job runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.columns import as_column, guarded

# Two ratios closer than this count as equal (relative and absolute part).
CLOSE_RELATIVE = 1e-5
CLOSE_ABSOLUTE = 1e-8


def _between(value: Column, low: float, high: float) -> Column:
    return (value >= low) & (value <= high)


def _number(value) -> Column:
    """A double in which NaN is missing, so that no comparison takes it for a large value."""
    return F.nullif(as_column(value).cast("double"), F.lit(float("nan")))


# ---------------------------------------------------------------- lifetime value

def value_rules(margin, retention, discount) -> list[tuple[Column, str]]:
    m, r, d = _number(margin), _number(retention), _number(discount)
    return [
        (m >= 0, "margin must not be negative"),
        (_between(r, 0, 1), "retention must lie between 0 and 1"),
        (d > -1, "discount must be above -1"),
    ]


def clv_infinite(margin, retention, discount, on_invalid: str = "null") -> Column:
    """m·r / (1 + d − r)."""
    m, r, d = _number(margin), _number(retention), _number(discount)
    rules = [*value_rules(margin, retention, discount), (1 + d - r > 0, "the endless sum does not converge")]
    return guarded(m * r / (1 + d - r), rules, on_invalid)


def clv_finite(margin, retention, discount, periods, on_invalid: str = "null") -> Column:
    """Value of the next ``periods`` margins, each at the end of its period."""
    m, r, d = _number(margin), _number(retention), _number(discount)
    n = as_column(periods).cast("long")
    q = r / (1 + d)
    flat = F.abs(q - 1) <= CLOSE_ABSOLUTE + CLOSE_RELATIVE
    # The divisor is made safe inside the branch that is not taken, so no row divides by zero.
    geometric = q * (1 - F.pow(q, n)) / F.when(flat, F.lit(1.0)).otherwise(1 - q)
    value = F.when(n == 0, F.lit(0.0)).when(flat, m * n).otherwise(m * geometric)
    rules = [*value_rules(margin, retention, discount), (n >= 0, "periods must not be negative")]
    return guarded(value, rules, on_invalid)


def clv_growth(margin, retention, discount, growth, on_invalid: str = "null") -> Column:
    """Endless value when the margin grows by ``growth`` per period."""
    m, r, d, g = _number(margin), _number(retention), _number(discount), _number(growth)
    spread = 1 + d - r * (1 + g)
    rules = [*value_rules(margin, retention, discount), (spread > 0, "the endless sum does not converge")]
    return guarded(m * r / spread, rules, on_invalid)


def clv_timed(margin, retention, discount, first, last, on_invalid: str = "null") -> Column:
    """Value of the margins of periods ``first`` to ``last``; period 0 is today, not discounted."""
    m, r, d = _number(margin), _number(retention), _number(discount)
    a, b = as_column(first).cast("long"), as_column(last).cast("long")
    q = r / (1 + d)
    closed = F.pow(q, a) * (1 - F.pow(q, b - a + 1)) / F.when(q == 1, F.lit(1.0)).otherwise(1 - q)
    value = m * F.when(q == 1, (b - a + 1).cast("double")).otherwise(closed)
    rules = [*value_rules(margin, retention, discount), ((a >= 0) & (b >= a), "need 0 <= first <= last")]
    return guarded(value, rules, on_invalid)


def clv_retention_elasticity(retention, discount, on_invalid: str = "null") -> Column:
    """Percent of value per percent of retention: one plus the margin multiple."""
    return 1 + clv_infinite(F.lit(1.0), retention, discount, on_invalid)


# ---------------------------------------------------------------- targeting

def gini_impurity(rate, on_invalid: str = "null") -> Column:
    p = _number(rate)
    return guarded(2 * p * (1 - p), [(_between(p, 0, 1), "rate must lie between 0 and 1")], on_invalid)


def break_even_probability(value_response, value_no_response, on_invalid: str = "null") -> Column:
    """Response probability at which a contact pays for itself, held within 0..1."""
    vr, vn = _number(value_response), _number(value_no_response)
    raw = -vn / F.when(vr > vn, vr - vn)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return guarded(value, [(vr > vn, "profit of a response must exceed profit without one")], on_invalid)


# ---------------------------------------------------------------- spend and acquisition curves

def ceiling_rate(spend, ceiling, steepness) -> Column:
    """Rate reached by ``spend``: C (1 − e^(−βs))."""
    return _number(ceiling) * (1 - F.exp(-_number(steepness) * _number(spend)))


def curve_steepness(spend, rate, ceiling, on_invalid: str = "null") -> Column:
    """β of the ceiling curve through one observed (spend, rate)."""
    s, p, c = _number(spend), _number(rate), _number(ceiling)
    good = (s > 0) & (p > 0) & (p < c) & (c <= 1)
    left = F.when(good, (c - p) / c)
    return guarded(-F.log(left) / F.when(s > 0, s), [(good, "need spend > 0 and 0 < rate < ceiling <= 1")],
                   on_invalid)


def acquisition_curve(period, alpha, beta, gamma) -> Column:
    """New customers per period: slope of the logistic α / (1 + e^(−β−γt))."""
    t, al, be, ga = (_number(v) for v in (period, alpha, beta, gamma))
    # The bell is even in its exponent, so the shrinking side of it never overflows.
    e = F.exp(-F.abs(be + ga * t))
    return al * ga * e / ((1 + e) * (1 + e))


def prospect_value(acquisition_spend, retention_spend, acquisition_ceiling, retention_ceiling,
                   acquisition_steepness, retention_steepness, margin, discount) -> Column:
    """Struct of prospect value, both rates and the value of an acquired customer."""
    def cost(spend, rate, ceiling, steepness):
        # Fixed value: below this rate the limit of spend/rate at zero spend is used.
        return F.when(rate > 1e-12, spend / F.when(rate > 1e-12, rate)).otherwise(1 / (ceiling * steepness))

    a_spend, r_spend = _number(acquisition_spend), _number(retention_spend)
    a_top, r_top = _number(acquisition_ceiling), _number(retention_ceiling)
    a_beta, r_beta = _number(acquisition_steepness), _number(retention_steepness)
    m, d = _number(margin), _number(discount)
    a, r = ceiling_rate(a_spend, a_top, a_beta), ceiling_rate(r_spend, r_top, r_beta)
    spread = 1 + d - r
    worst = F.lit(float("-inf"))
    customer = (m - cost(a_spend, a, a_top, a_beta)) + (
        m - cost(r_spend, r, r_top, r_beta)) * r / F.when(spread > 0, spread)
    return F.struct(
        F.when(spread <= 0, worst).otherwise(a * customer).alias("prospect_value"),
        a.alias("acquisition_rate"),
        r.alias("retention_rate"),
        F.when(spread <= 0, worst).otherwise(customer).alias("customer_value"),
    )


# ---------------------------------------------------------------- service recovery

def recovery_rules(future, recovered, unrecovered) -> list[tuple[Column, str]]:
    v, p, q = _number(future), _number(recovered), _number(unrecovered)
    return [
        (v >= 0, "future value must not be negative"),
        (_between(p, 0, 1) & _between(q, 0, 1), "probabilities must lie between 0 and 1"),
    ]
