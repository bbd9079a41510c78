"""Shifted beta-geometric survival (Fader & Hardie 2007) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.columns import as_column
from patronage.functions.special import log_beta


def _doubles(*values) -> list[Column]:
    return [as_column(v).cast("double") for v in values]


def sbg_survival(period, alpha, beta) -> Column:
    """S(t) = B(α, β+t) / B(α, β)."""
    t, a, b = _doubles(period, alpha, beta)
    return F.exp(log_beta(a, b + t) - log_beta(a, b))


def sbg_retention(period, alpha, beta) -> Column:
    """Share of the survivors of t−1 who renew in t."""
    t, a, b = _doubles(period, alpha, beta)
    return (b + t - 1) / (a + b + t - 1)


def sbg_duration_probability(period, alpha, beta) -> Column:
    """P(T = t) = B(α+1, β+t−1) / B(α, β)."""
    t, a, b = _doubles(period, alpha, beta)
    return F.exp(log_beta(a + 1, b + t - 1) - log_beta(a, b))
