"""BG/BB scores for given parameters (Fader, Hardie & Shang 2010).

n = observed periods, tx = last period with a purchase (0 if none), x = periods with a purchase.
The paths "left after period tx+j" form a series whose neighbouring terms have a simple ratio, so
the sum needs Beta functions once, not once per path; and Beta functions whole steps apart are
products, so no Gamma function is needed at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.columns import as_column, guarded
from patronage.functions.special import log_add_exp, log_rising, ratio_series


def _history(n, tx, x) -> list[Column]:
    return [as_column(v).cast("int") for v in (n, tx, x)]


def _doubles(*values) -> list[Column]:
    return [as_column(v).cast("double") for v in values]


def bgbb_rules(n, tx, x) -> list[tuple[Column, str]]:
    n, tx, x = _history(n, tx, x)
    return [((n >= 1) & (x >= 0) & (x <= tx) & (tx <= n), "need n >= 1 and 0 <= x <= tx <= n")]


def bgbb_history_probability(n, tx, x, p, q, on_invalid: str = "null") -> Column:
    """Probability of one history for fixed purchase and dropout probabilities."""
    rules = [*bgbb_rules(n, tx, x)]
    n, tx, x = _history(n, tx, x)
    p, q = _doubles(p, q)
    rules.append(((p >= 0) & (p <= 1) & (q >= 0) & (q <= 1), "p and q must lie between 0 and 1"))
    bought = F.pow(p, x)
    stayed = bought * F.pow(1 - p, n - x) * F.pow(1 - q, n)
    silent = (1 - p) * (1 - q)
    left = F.when(
        n > tx, bought * F.pow(1 - p, tx - x) * q * F.pow(1 - q, tx) * ratio_series(n - tx - 1, lambda k: silent)
    ).otherwise(F.lit(0.0))
    return guarded(stayed + left, rules, on_invalid)


def bgbb_alive_fixed(n, tx, x, p, q, on_invalid: str = "null") -> Column:
    """P(alive entering period n+1) for fixed p and q; 0 when the history is impossible."""
    likelihood = bgbb_history_probability(n, tx, x, p, q, on_invalid)
    n, tx, x = _history(n, tx, x)
    p, q = _doubles(p, q)
    alive = F.pow(p, x) * F.pow(1 - p, n - x) * F.pow(1 - q, n + 1)
    return F.when(likelihood == 0, F.lit(0.0)).otherwise(alive / F.when(likelihood != 0, likelihood))


def bgbb_log_likelihood(n, tx, x, alpha, beta, gamma, delta) -> Column:
    """ln L of one history with Beta(α, β) purchase and Beta(γ, δ) dropout probabilities."""
    n, tx, x = _history(n, tx, x)
    al, be, ga, de = _doubles(alpha, beta, gamma, delta)
    # Beta functions whose arguments are whole steps apart are ratios of rising products.
    alive = log_rising(al, x) + log_rising(be, n - x) - log_rising(al + be, n) \
        + log_rising(de, n) - log_rising(ga + de, n)
    first = log_rising(al, x) + log_rising(be, tx - x) - log_rising(al + be, tx) \
        + F.log(ga) + log_rising(de, tx) - log_rising(ga + de, tx + 1)
    paths = ratio_series(
        n - tx - 1,
        lambda k: (be + tx - x + k - 1) / (al + be + tx + k - 1) * (de + tx + k - 1) / (ga + de + tx + k),
    )
    return log_add_exp(alive, F.when(n > tx, first + F.log(paths)))


def bgbb_probability_alive(n, tx, x, alpha, beta, gamma, delta) -> Column:
    """P(alive entering period n+1)."""
    likelihood = bgbb_log_likelihood(n, tx, x, alpha, beta, gamma, delta)
    n, tx, x = _history(n, tx, x)
    al, be, ga, de = _doubles(alpha, beta, gamma, delta)
    alive = log_rising(al, x) + log_rising(be, n - x) - log_rising(al + be, n) \
        + log_rising(de, n + 1) - log_rising(ga + de, n + 1)
    return F.exp(alive - likelihood)


def bgbb_expected_purchases(n, tx, x, periods, alpha, beta, gamma, delta, on_invalid: str = "null") -> Column:
    """Expected purchases in the next ``periods`` periods; 0 for none."""
    likelihood = bgbb_log_likelihood(n, tx, x, alpha, beta, gamma, delta)
    n, tx, x = _history(n, tx, x)
    al, be, ga, de = _doubles(alpha, beta, gamma, delta)
    m = as_column(periods).cast("int")
    buys = log_rising(al, x + 1) + log_rising(be, n - x) - log_rising(al + be, n + 1)
    # B(γ, δ+n+k) for k = 1..m, as the first term times a ratio series.
    first = log_rising(de, n + 1) - log_rising(ga + de, n + 1)
    ahead = F.log(ratio_series(m - 1, lambda k: (de + n + k) / (ga + de + n + k)))
    value = F.when(m == 0, F.lit(0.0)).otherwise(F.exp(buys - likelihood + first + ahead))
    return guarded(value, [(m >= 0, "future periods must not be negative")], on_invalid)
