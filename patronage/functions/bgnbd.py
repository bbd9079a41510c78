"""BG/NBD scores for given parameters (Fader, Hardie & Lee 2005).

x = repeat purchases, tx = time of the last one, T = length of the observation, all per customer.
Parameters may be numbers or columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.columns import as_column
from patronage.functions.special import hyp2f1, log_add_exp, log_beta, log_gamma


def _doubles(*values) -> list[Column]:
    return [as_column(v).cast("double") for v in values]


def bgnbd_rules(x, tx, T) -> list[tuple[Column, str]]:
    x, tx, T = _doubles(x, tx, T)
    top = F.lit(float("inf"))
    return [
        ((x < top) & (tx < top) & (T < top), "x, tx and T must be finite"),
        ((x >= 0) & (tx >= 0) & (tx <= T) & (T > 0), "need x >= 0, 0 <= tx <= T and T > 0"),
    ]


def bgnbd_log_likelihood(x, tx, T, r, alpha, a, b) -> Column:
    """ln L of one history; −∞ when a parameter is not positive."""
    x, tx, T, r, alpha, a, b = _doubles(x, tx, T, r, alpha, a, b)
    purchases = log_gamma(r + x) - log_gamma(r) + r * F.log(alpha)
    survivals = log_beta(a, b + x) - log_beta(a, b)
    stayed = -(r + x) * F.log(alpha + T)
    left = F.when(x > 0, F.log(a / (b + x - 1)) - (r + x) * F.log(alpha + tx))
    positive = F.least(r, alpha, a, b) > 0
    # B(a, b+x)/B(a, b) carries Γ(b+x)Γ(a+b)/(Γ(b)Γ(a+b+x)); Γ(a) cancels.
    return F.when(positive, purchases + survivals + log_add_exp(stayed, left)).otherwise(F.lit(float("-inf")))


def probability_active(x, tx, T, r, alpha, a, b) -> Column:
    """P(still active at the end of the observation); 1 without repeat purchases."""
    x, tx, T, r, alpha, a, b = _doubles(x, tx, T, r, alpha, a, b)
    odds = F.when(x > 0, a / (b + x - 1) * F.pow((alpha + T) / (alpha + tx), r + x)).otherwise(F.lit(0.0))
    return 1 / (1 + odds)


def expected_if_active(x, T, horizon, r, alpha, a, b) -> Column:
    """Expected purchases over ``horizon`` of a customer who is still active.

    Two equal forms of the hypergeometric term, chosen per row. Euler's transformation converges in
    tens of terms where the plain series needs thousands, but it fails for large ``a``; there the
    plain form is the short one. At a = 1 numerator and denominator vanish together, so the value is
    taken as the mean of both sides.
    """
    x, T, h, r, alpha, a, b = _doubles(x, T, horizon, r, alpha, a, b)
    step = 1e-6
    at_pole = F.abs(a - 1) < step

    def one_side(a: Column) -> Column:
        z = h / (alpha + T + h)
        base = (alpha + T) / (alpha + T + h)
        c = a + b + x - 1
        transform = a - 1 < r + x
        first = F.when(transform, a + b - 1 - r).otherwise(r + x)
        second = F.when(transform, a - 1).otherwise(b + x)
        power = F.when(transform, a - 1).otherwise(r + x)
        return c / (a - 1) * (1 - F.pow(base, power) * hyp2f1(first, second, c, z))

    low = one_side(F.when(at_pole, F.lit(1.0 - step)).otherwise(a))
    high = one_side(F.when(at_pole, F.lit(1.0 + step)).otherwise(a))
    return F.when(at_pole, (low + high) / 2).otherwise(low)
