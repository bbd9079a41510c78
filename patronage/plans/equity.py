"""Customer equity: what the customers of today and of the years ahead are worth, per segment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import field, names, reason_column
from patronage.errors import InputProblem
from patronage.functions.value import acquisition_curve, clv_infinite
from patronage.plans.series import pack_series, total
from patronage.scratch import stored

# Fewest observations, box of (alpha, beta, gamma), starts for (beta, gamma), and how far
# below zero rounding may push an acquisition count.
FEWEST_POINTS = 4
ALPHA_LEAST, ALPHA_FACTOR, ALPHA_ROOM = 1e-10, 1000.0, 1e12
BETA_BOUND = 50.0
GAMMA_BOUNDS = (1e-8, 20.0)
STARTS = ((-2.0, 0.2), (-4.0, 0.1), (0.0, 0.5), (-6.0, 0.05))
BELOW_ZERO = -1e-8
# Fixed value: the highest retention an improvement may reach.
MOST_RETENTION = 1 - 1e-10

CURVE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("alpha", "beta", "gamma", "sse", "r_squared")])


def _bell(t: np.ndarray, beta: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(beta + gamma * t))
    return gamma * e / (1 + e) ** 2


def _fit_bells(t: np.ndarray, y: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Least squares of many short series at once: rows of (alpha, beta, gamma, sse, r_squared).

    ``t`` and ``y`` are series by period, padded where ``real`` is 0. For given (beta, gamma) the best alpha has a closed
    form, so the search has two dimensions: a coarse grid over peak position and width and the known starts, then a grid
    that follows the best cell and shrinks around it.
    """
    n = real.sum(1)
    low, high = np.where(real > 0, t, np.inf).min(1), np.where(real > 0, t, -np.inf).max(1)
    most = np.maximum(np.maximum.reduce([2 * y.sum(1), 4 * y.max(1), np.ones(len(y))]) * ALPHA_FACTOR, ALPHA_ROOM)

    def best_of(rows, beta, log_gamma):
        """Best of the points of each row: sse, beta, log gamma, alpha."""
        beta = np.clip(beta, -BETA_BOUND, BETA_BOUND)
        log_gamma = np.clip(log_gamma, *np.log(GAMMA_BOUNDS))
        shape = _bell(t[rows][:, None, :], beta[..., None], np.exp(log_gamma)[..., None]) * real[rows][:, None, :]
        power = (shape * shape).sum(2)
        alpha = (shape * y[rows][:, None, :]).sum(2) / np.where(power > 0, power, 1.0)
        alpha = np.clip(alpha, ALPHA_LEAST, most[rows][:, None])
        # Residuals, not the expanded square: the sum keeps its digits for close fits.
        sse = ((alpha[..., None] * shape - y[rows][:, None, :]) ** 2).sum(2)
        at = (np.arange(len(rows)), sse.argmin(1))
        return sse[at], beta[at], log_gamma[at], alpha[at]

    every = np.arange(len(t))
    span = np.maximum(high - low, 1.0)[:, None]
    widths = np.exp(np.linspace(np.log(0.2 / span[:, 0]), np.log(4.0), 21, axis=1))
    peaks = np.linspace(low - span[:, 0], high + 2 * span[:, 0], 61, axis=1)
    gammas = np.tile(widths, (1, 61))
    at = np.repeat(peaks, 21, axis=1)
    found = [best_of(every, -gammas * at, np.log(gammas))]
    found += [best_of(every, np.full((len(t), 1), b), np.full((len(t), 1), np.log(g))) for b, g in STARTS]

    rows = np.tile(every, len(found))
    sse, beta, log_gamma, alpha = (np.concatenate(part) for part in zip(*found))
    # The frame (height at the centre of the data, gamma) is less slanted than (beta, gamma).
    centre = (np.where(real > 0, t, 0).sum(1) / n)[rows]
    reach_u, reach_v = np.full(len(rows), 1.0), np.full(len(rows), 0.5)
    unit = np.linspace(-1, 1, 9)
    du, dv = (a.ravel()[None, :] for a in np.meshgrid(unit, unit))
    for _ in range(400):
        go = np.flatnonzero(np.maximum(reach_u, reach_v) >= 1e-11)
        if not len(go):
            break
        u, v, mid = reach_u[go][:, None], reach_v[go][:, None], centre[go][:, None]
        was_beta, was_gamma = beta[go], log_gamma[go]
        height = was_beta[:, None] + np.exp(was_gamma)[:, None] * mid + u * du
        gamma = np.exp(was_gamma[:, None] + v * dv)
        new = best_of(rows[go], height - gamma * mid, was_gamma[:, None] + v * dv)
        moved = new[0] < sse[go]
        shift = np.abs(new[1] + np.exp(new[2]) * centre[go] - was_beta - np.exp(was_gamma) * centre[go])
        edge = moved & ((np.abs(new[2] - was_gamma) > 0.9 * reach_v[go]) | (shift > 0.9 * reach_u[go]))
        for old, now in zip((sse, beta, log_gamma, alpha), new):
            old[go] = np.where(moved, now, old[go])
        shrink = np.where(edge, 1.0, 0.5)
        reach_u[go] *= shrink
        reach_v[go] *= shrink

    best = sse.reshape(len(found), -1).argmin(0) * len(t) + every
    mean = y.sum(1) / n
    spread = (((y - mean[:, None]) * real) ** 2).sum(1)
    r_squared = np.where(spread > 0, 1 - sse[best] / np.where(spread > 0, spread, 1), 1.0)
    return np.column_stack([alpha[best], beta[best], np.exp(log_gamma[best]), sse[best], r_squared])


# Series that are fitted together; bounds the arrays of a search step.
TOGETHER = 64


@F.pandas_udf(CURVE)
def _fit_curves(t: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Curve per (t, y) series; NULL series give NULL curves."""
    out = np.full((len(t), len(CURVE.names)), np.nan)
    usable = [i for i, (times, values) in enumerate(zip(t, y)) if times is not None and values is not None]
    usable.sort(key=lambda i: len(t.iloc[i]))
    for i in range(0, len(usable), TOGETHER):
        part = usable[i:i + TOGETHER]
        longest = len(t.iloc[part[-1]])
        times, values, real = (np.zeros((len(part), longest)) for _ in range(3))
        for row, k in enumerate(part):
            size = len(t.iloc[k])
            times[row, :size], values[row, :size], real[row, :size] = t.iloc[k], y.iloc[k], 1.0
        out[part] = _fit_bells(times, values, real)
    return pd.DataFrame(out, columns=CURVE.names)


def _fit(series: DataFrame, times: Column, values: Column, into: str) -> DataFrame:
    return series.withColumn(into, _fit_curves(times, values))


def fit_acquisition_curve(df: DataFrame, keys: str | Sequence[str] | None, period: str, acquired: str,
                          on_invalid: str = "error") -> DataFrame:
    """(keys, alpha, beta, gamma, sse, r_squared) per segment; negative or missing counts are left out."""
    k = [field(c) for c in names(keys)]
    rows = pack_series(df.where(field(acquired) >= 0), keys, period, acquired)
    rules = [(~F.col("repeats"), "a period comes twice"),
             (F.size("t") >= FEWEST_POINTS, "at least four non-negative acquisition counts are needed")]
    rows = rows.withColumn("invalid_reason", reason_column(rules, on_invalid))
    good = F.col("invalid_reason").isNull()
    fitted = _fit(rows, F.when(good, F.col("t")), F.when(good, F.col("y")), "_c")
    return stored(fitted.select(*k, *[F.when(good, F.col(f"_c.{c}")).alias(c) for c in CURVE.names],
                                "invalid_reason"), "acquisition-curves")


@dataclass(frozen=True)
class EquityResult:
    """``summary`` (a row per segment), ``history`` and ``forecast`` (a row per period), ``elasticities``."""

    summary: DataFrame
    history: DataFrame
    forecast: DataFrame
    elasticities: DataFrame

    def series(self, keys: str | Sequence[str] | None = None) -> DataFrame:
        """Observed, fitted and forecast acquisitions below each other: (keys, period, customers, series)."""
        k = names(keys)

        def part(df: DataFrame, column: str, label: str) -> DataFrame:
            return df.select(*map(field, k), "period", F.col(column).alias("customers"), F.lit(label).alias("series"))

        return part(self.history, "observed_acquired", "Observed").unionByName(
            part(self.history, "fitted_acquired", "Fitted")).unionByName(
            part(self.forecast, "forecast_acquired", "Forecast"))


def _gained(retention: Column) -> Column:
    """Acquisitions per period from the counts ``y``, from the second period on."""
    return F.zip_with(F.slice("y", 2, F.size("y")), F.slice("y", 1, F.size("y") - 1),
                      lambda now, before: now - retention * before)


def customer_equity(df: DataFrame, keys: str | Sequence[str] | None, period: str, customers: str, *,
                    acquisition_cost, margin, retention, discount, tax_rate=0.0, forecast_periods: int = 100,
                    periods_per_year: int = 1, change: float = 0.01, on_invalid: str = "error",
                    given: tuple[float, float, float] | None = None) -> EquityResult:
    """Value of present and future customers per segment, from a history of customer counts.

    The count history is put in period order. Margin, retention and the other inputs are numbers for
    all segments. A one-percent better margin or acquisition cost leaves past acquisitions unchanged,
    so the elasticities need two curve fits per segment, with today's and with the better retention.
    ``given`` (alpha, beta, gamma) is a known acquisition curve for all segments; then nothing is fitted.
    """
    if periods_per_year < 1:
        raise InputProblem("Periods per year must be at least one.")
    if not 0 <= tax_rate <= 1:
        raise InputProblem("The tax rate must lie between 0 and 1.")
    if not 0 <= retention <= 1:
        raise InputProblem("Retention must lie between 0 and 1.")
    if forecast_periods < 0:
        raise InputProblem("Forecast periods cannot be negative.")
    k = [field(c) for c in names(keys)]
    better = min(retention * (1 + change) ** (1 / periods_per_year), MOST_RETENTION)
    horizon = F.sequence(F.lit(1), F.lit(int(forecast_periods))) if forecast_periods \
        else F.array().cast("array<int>")

    packed = pack_series(df, keys, period, customers)
    packed = packed.withColumns({
        "_times": F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))),
        "_base": _gained(F.lit(float(retention))), "_better": _gained(F.lit(float(better)))})
    rules = [
        (~F.col("repeats"), "a period comes twice"),
        (F.size("t") > FEWEST_POINTS, "at least five customer counts are needed"),
        (F.forall("y", lambda v: v >= 0), "customer counts must not be negative"),
        (F.forall("_base", lambda v: v >= BELOW_ZERO), "this retention implies negative acquisitions"),
    ]
    packed = packed.withColumn("invalid_reason", reason_column(rules, on_invalid))
    good = F.col("invalid_reason").isNull()
    reachable = good & F.forall("_better", lambda v: v >= BELOW_ZERO)

    def floor(name: str) -> Column:
        return F.transform(name, lambda v: F.greatest(v, F.lit(0.0)))

    packed = packed.withColumns({"_base": floor("_base"), "_better": floor("_better")})
    if given is None:
        fitted = _fit(packed, F.when(good, F.col("_times")), F.when(good, F.col("_base")), "_curve")
        fitted = _fit(fitted, F.when(reachable, F.col("_times")), F.when(reachable, F.col("_better")), "_curve_better")
        fitted = stored(fitted.drop("repeats"), "equity-fits")
    else:
        curve = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(CURVE.names, given)],
                         *[F.lit(None).cast("double").alias(n) for n in CURVE.names[3:]])
        fitted = packed.drop("repeats").withColumns(
            {"_curve": F.when(good, curve), "_curve_better": F.when(reachable, curve)})

    cost, tax = float(acquisition_cost), float(tax_rate)
    last_t, last_n = F.element_at("t", -1), F.element_at("y", -1)

    def value_of(m: float, r: float) -> Column:
        return clv_infinite(F.lit(float(m)), F.lit(float(r)), F.lit(float(discount)), "error")

    def ahead(curve: str) -> Column:
        """Discounted acquisitions over the horizon."""
        return total(F.transform(horizon, lambda i: acquisition_curve(
            last_t + i, f"{curve}_alpha", f"{curve}_beta", f"{curve}_gamma") / F.pow(F.lit(1.0 + discount), i)))

    def equity(curve: str, m: float, r: float, c: float) -> Column:
        clv = value_of(m, r)
        return (last_n * clv + (clv - F.lit(c)) * ahead(curve)) * F.lit(1 - tax)

    flat = fitted.where(F.col("invalid_reason").isNull())
    for curve in ("_curve", "_curve_better"):
        flat = flat.withColumns({f"{curve}_{c}": F.col(f"{curve}.{c}") for c in CURVE.names})
    clv = value_of(margin, retention)
    summary = fitted.select(*k, "t", "y", "invalid_reason", *[
        F.col(f"_curve.{c}").alias(f"_curve_{c}") for c in CURVE.names])
    summary = summary.withColumns({"clv": F.when(F.col("invalid_reason").isNull(), clv), "_ahead": F.when(
        F.col("invalid_reason").isNull(), ahead("_curve"))})
    summary = summary.withColumns({
        "current_customer_value": last_n * F.col("clv"),
        "future_customer_value": (F.col("clv") - F.lit(cost)) * F.col("_ahead")})
    pre_tax = F.col("current_customer_value") + F.col("future_customer_value")
    summary = summary.withColumn("pre_tax_customer_equity", pre_tax).select(
        *k, "clv", "current_customer_value", "future_customer_value", "pre_tax_customer_equity",
        (F.col("pre_tax_customer_equity") * F.lit(1 - tax)).alias("customer_equity"), F.lit(tax).alias("tax_rate"),
        *[F.col(f"_curve_{c}").alias(c) for c in CURVE.names], "invalid_reason")

    observed = flat.select(*k, "_curve", F.explode(F.arrays_zip("_times", "_base")).alias("o"))
    history = observed.select(
        *k, F.col("o._times").alias("period"), F.col("o._base").alias("observed_acquired"),
        acquisition_curve(F.col("o._times"), F.col("_curve.alpha"), F.col("_curve.beta"),
                          F.col("_curve.gamma")).alias("fitted_acquired"))
    future = flat.select(*k, last_t.alias("_last"), "_curve", F.explode(horizon).alias("period_ahead"))
    future = future.withColumn("period", F.col("_last") + F.col("period_ahead")).withColumn(
        "forecast_acquired", acquisition_curve(
            F.col("period"), F.col("_curve.alpha"), F.col("_curve.beta"), F.col("_curve.gamma")))
    discounted = F.col("forecast_acquired") / F.pow(F.lit(1.0 + discount), F.col("period_ahead"))
    forecast = future.withColumn("discounted_acquired", discounted).select(
        *k, "period_ahead", "period", "forecast_acquired", "discounted_acquired",
        ((clv - F.lit(cost)) * F.col("discounted_acquired")).alias("future_value_contribution"))

    drivers = F.array(*[
        F.struct(F.lit(name).alias("driver"), revised.alias("revised"))
        for name, revised in (
            ("margin increase", equity("_curve", margin * (1 + change), retention, cost)),
            ("retention increase", equity("_curve_better", margin, better, cost)),
            ("acquisition cost reduction", equity("_curve", margin, retention, cost * (1 - change))))])
    compared = flat.withColumn("base_customer_equity", equity("_curve", margin, retention, cost)).select(
        *k, "base_customer_equity", F.explode(drivers).alias("d"))
    base, revised = F.col("base_customer_equity"), F.col("d.revised")
    elasticities = compared.select(
        *k, F.col("d.driver").alias("driver"), "base_customer_equity", revised.alias("revised_customer_equity"),
        # Undefined without any base value, and where the better retention contradicts the history.
        ((revised - base) / F.when(base != 0, base) / F.lit(change)).alias("elasticity"))
    return EquityResult(summary, history, forecast, elasticities)
