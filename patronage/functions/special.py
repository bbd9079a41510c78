"""Gamma-family functions as native column expressions, and the one Arrow function.

``log_gamma`` shifts its argument up by eight and applies Stirling's series (Abramowitz & Stegun
6.1.40); ``digamma`` and ``trigamma`` are the derivatives of the same form (6.3.18, 6.4.12).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SHIFT = 8

# Series coefficients B(2k)/(2k(2k-1)), B(2k)/(2k) and B(2k).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
DIGAMMA_SERIES = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)
TRIGAMMA_SERIES = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)


def _horner(coefficients, variable: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * variable + F.lit(c)
    return total


def log_gamma(z: Column) -> Column:
    """ln Γ(z) for z > 0."""
    product = z
    for k in range(1, SHIFT):
        product = product * (z + F.lit(float(k)))
    y = z + F.lit(float(SHIFT))
    series = _horner(STIRLING, 1 / (y * y)) / y
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product)


def digamma(z: Column) -> Column:
    """Derivative of ln Γ."""
    steps = 1 / z
    for k in range(1, SHIFT):
        steps = steps + 1 / (z + F.lit(float(k)))
    y = z + F.lit(float(SHIFT))
    s = 1 / (y * y)
    return F.log(y) - 0.5 / y - s * _horner(DIGAMMA_SERIES, s) - steps


def trigamma(z: Column) -> Column:
    """Second derivative of ln Γ."""
    steps = 1 / (z * z)
    for k in range(1, SHIFT):
        step = z + F.lit(float(k))
        steps = steps + 1 / (step * step)
    y = z + F.lit(float(SHIFT))
    s = 1 / (y * y)
    return 1 / y + 0.5 * s + s / y * _horner(TRIGAMMA_SERIES, s) + steps


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_rising(start: Column, steps: Column) -> Column:
    """ln Γ(start + steps) − ln Γ(start) for a whole number of steps: Σ ln(start + k), k < steps."""
    upward = F.when(steps >= 1, F.sequence(F.lit(1), steps))
    total = F.aggregate(upward, F.lit(0.0), lambda acc, k: acc + F.log(start + k - 1))
    return F.coalesce(total, F.lit(0.0))


def log_sum_exp(terms: Column) -> Column:
    """ln Σ exp(term) over an array column, without overflow."""
    top = F.array_max(terms)
    parts = F.aggregate(terms, F.lit(0.0), lambda total, v: total + F.exp(v - top))
    return top + F.log(parts)


def log_add_exp(u: Column, v: Column) -> Column:
    """ln(exp(u) + exp(v)); a NULL second term counts as ln 0."""
    return F.when(v.isNull(), u).otherwise(F.greatest(u, v) + F.log1p(F.exp(-F.abs(u - v))))


def ratio_series(steps: Column, ratio) -> Column:
    """1 + q(1)(1 + q(2)(1 + ... (1 + q(steps)))), the sum of a series given by term ratios.

    ``steps`` may be 0 (the sum is 1); ``ratio(k)`` gives q(k) for k >= 1.
    """
    downward = F.when(steps >= 1, F.sequence(steps, F.lit(1), F.lit(-1)))
    total = F.aggregate(downward, F.lit(1.0), lambda acc, k: 1.0 + ratio(k) * acc)
    return F.coalesce(total, F.lit(1.0))


# Up to here the series in powers of z is summed as it stands; beyond, the function is carried on towards 1.
NEAR = 0.75


def _power_series(a, b, c, z, tolerance: float) -> np.ndarray:
    """Sum of (a)_k (b)_k / (c)_k z^k / k! for z up to ``NEAR``.

    The ratio of successive terms tends to z, so every entry finishes; finished ones leave the loop.
    """
    total, term = np.ones(a.shape), np.ones(a.shape)
    live, k = np.arange(a.size), 0
    while live.size:
        with np.errstate(all="ignore"):
            ratio = (a[live] + k) * (b[live] + k) / ((c[live] + k) * (k + 1.0)) * z[live]
            term[live] = term[live] * ratio
            total[live] += term[live]
            # Once ratios fall below one for good, the tail is bounded by a geometric series.
            tail = np.abs(term[live]) / np.maximum(1.0 - np.abs(ratio), 1e-3)
        done = (np.abs(ratio) < 1.0) & (tail <= tolerance * np.abs(total[live])) | ~np.isfinite(total[live])
        live = live[~done]
        k += 1
    return total


def _carried(a, b, c, start, end, value, slope, tolerance: float):
    """Value and slope at ``end`` from those at ``start``, by the Taylor series of the hypergeometric equation.

    ``end`` lies at most half way to 1, so terms halve. For positive parameters all of them are positive: nothing cancels.
    """
    step = end - start
    before, now = value.copy(), slope * step  # terms 0 and 1, already times step^k
    total, rise = value + now, slope.copy()
    live, k = np.arange(a.size), 0
    while live.size:
        la, lb, lc, z0, h = a[live], b[live], c[live], start[live], step[live]
        with np.errstate(all="ignore"):
            following = ((k + la) * (k + lb) * before[live] * h * h
                         - (k + 1) * ((1 - 2 * z0) * k + lc - (la + lb + 1) * z0) * now[live] * h) / (
                z0 * (1 - z0) * (k + 2) * (k + 1))
            ratio = np.abs(following / now[live])
            small = np.abs(following) / np.maximum(1.0 - ratio, 1e-3)
            total[live] += following
            rise[live] += (k + 2) * following / h
            done = (ratio < 1.0) & ((k + 2) * small <= tolerance * np.abs(rise[live] * h)) & (small <= tolerance * np.abs(total[live]))
        done |= ~np.isfinite(total[live]) | (following == 0) & (now[live] == 0)
        before[live], now[live] = now[live], following
        live = live[~done]
        k += 1
    return total, rise


def hypergeometric_series(a, b, c, z, tolerance: float = 1e-16) -> np.ndarray:
    """Gauss's hypergeometric function over whole arrays, for 0 <= z < 1 and any distance from 1.

    Up to ``NEAR`` it is the sum of its series. From there it is carried on in steps that halve the distance to 1, about 20 of
    them for 1 - z = 1e-6 and 50 for the last number below 1.
    """
    a, b, c, z = (np.array(v, dtype=float).ravel() for v in np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, c, z))))
    out = np.full(a.shape, np.nan)
    known = np.isfinite(a) & np.isfinite(b) & np.isfinite(c) & (z >= 0) & (z < 1)
    near = known & (z <= NEAR)
    out[near] = _power_series(a[near], b[near], c[near], z[near], tolerance)
    far = np.flatnonzero(known & (z > NEAR))
    if far.size:
        la, lb, lc, at = a[far], b[far], c[far], np.full(far.size, NEAR)
        value = _power_series(la, lb, lc, at, tolerance)
        slope = la * lb / lc * _power_series(la + 1, lb + 1, lc + 1, at, tolerance)
        left = np.arange(far.size)
        while left.size:
            goal = np.minimum(z[far][left], at[left] + (1 - at[left]) / 2)
            value[left], slope[left] = _carried(la[left], lb[left], lc[left], at[left], goal, value[left], slope[left], tolerance)
            at[left] = goal
            left = left[at[left] < z[far][left]]
        out[far] = value
    return out


@F.pandas_udf(DoubleType())
def hyp2f1(a: pd.Series, b: pd.Series, c: pd.Series, z: pd.Series) -> pd.Series:
    """Gauss hypergeometric function for 0 <= z < 1, one Arrow batch at a time."""
    return pd.Series(hypergeometric_series(a, b, c, z))
