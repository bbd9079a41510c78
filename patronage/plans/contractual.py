"""Subscription cohorts: fitting the shifted beta-geometric and forecasting retention."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import field, names, reason_column
from patronage.errors import InputProblem
from patronage.functions.subscription import sbg_retention, sbg_survival
from patronage.plans.series import pack_series, total
from patronage.scratch import stored

# Bound of the log parameters, the four starts (alpha, beta), shortest curve, and how
# much a survivor count may rise by rounding.
LOG_BOUND = 12.0
STARTS = ((1.0, 1.0), (0.5, 2.0), (2.0, 5.0), (0.2, 0.8))
SHORTEST_CURVE = 3
RISE = 1e-9

FIT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("alpha", "beta", "log_likelihood")]
                   + [T.StructField(c, T.BooleanType()) for c in ("success", "at_bounds")])


def prepare_survivors(df: DataFrame, keys: str | Sequence[str] | None, period: str, survivors: str,
                      on_invalid: str = "error") -> DataFrame:
    """One row per cohort with its survivor counts for periods 0..K, checked.

    Periods must be 0, 1, ..., K without gaps or repeats (at least three), the first count positive
    and no count above the one before. ``on_invalid='null'`` keeps broken cohorts with ``invalid_reason``.
    """
    packed = pack_series(df, keys, period, survivors)
    k = [field(c) for c in names(keys)]
    t = F.transform("t", lambda v: v.cast("int"))
    steps = F.forall(F.zip_with(t, F.sequence(F.lit(0), F.size("t") - 1), lambda a, b: a == b), lambda ok: ok)
    falling = F.forall(
        F.zip_with(F.slice("y", 2, F.size("y")), F.col("y"), lambda b, a: F.coalesce(b - a <= RISE, F.lit(True))),
        lambda ok: ok)
    reason = reason_column([
        (~F.col("repeats") & (F.size("t") >= SHORTEST_CURVE) & steps,
         "periods must be consecutive whole numbers that begin at 0"),
        (F.forall("y", lambda v: v >= 0) & falling & (F.get("y", F.lit(0)) > 0),
         "survivor counts must not be negative or rise over time"),
    ], on_invalid)
    return packed.select(*k, F.col("y").alias("survivors"), reason.alias("invalid_reason"))


def _climb(curves: list[np.ndarray]) -> pd.DataFrame:
    """Newton's method for all cohorts of a batch and all starts at once.

    With S(k) survivors and d(k) = S(k) − S(k+1), ln L = Σ d(k) ln α + S(k+1) ln(β+k) − S(k) ln(α+β+k):
    a renewal in step k has odds (β+k) to α. No Gamma functions, and derivatives are sums of fractions.
    """
    sizes = np.array([len(c) - 1 for c in curves])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    k = np.concatenate([np.arange(n) for n in sizes]).astype(float)
    s0 = np.concatenate([c[:-1] for c in curves])[:, None]
    s1 = np.concatenate([c[1:] for c in curves])[:, None]
    k = k[:, None]
    lost = np.add.reduceat(s0 - s1, first)

    def derivatives(p):
        a, b = np.exp(p[..., 0]), np.exp(p[..., 1])
        A, B = np.repeat(a, sizes, axis=0), np.repeat(b, sizes, axis=0)
        u, v = B + k, A + B + k
        value = lost * np.log(a) + np.add.reduceat(s1 * np.log(u) - s0 * np.log(v), first)
        out, back = np.add.reduceat(s0 / v, first), np.add.reduceat(s1 / u, first)
        out2, back2 = np.add.reduceat(s0 / v**2, first), np.add.reduceat(s1 / u**2, first)
        ga, gb = lost / a - out, back - out
        # In log parameters: multiply by the parameter, and add the gradient to the diagonal.
        haa = a * a * (out2 - lost / a**2) + a * ga
        hbb = b * b * (out2 - back2) + b * gb
        return value, np.stack([a * ga, b * gb], -1), (haa, a * b * out2, hbb)

    point = np.broadcast_to(np.log(STARTS), (len(curves), len(STARTS), 2)).copy()
    value, g, (haa, hab, hbb) = derivatives(point)
    damping = np.full(value.shape, 1e-3)
    done = np.zeros(value.shape, bool)
    for _ in range(200):
        # Eigenvalues of the 2x2 curvature, made positive; then the damped step in that frame.
        mean, half, off = -(haa + hbb) / 2, -(haa - hbb) / 2, -hab
        radius = np.hypot(half, off)
        angle = np.arctan2(off, half) / 2
        c, s = np.cos(angle), np.sin(angle)
        scale = np.maximum(np.abs(mean) + radius, 1e-300)
        e1 = np.maximum(np.abs(mean + radius), 1e-12 * scale) + damping * scale
        e2 = np.maximum(np.abs(mean - radius), 1e-12 * scale) + damping * scale
        g1, g2 = (c * g[..., 0] + s * g[..., 1]) / e1, (-s * g[..., 0] + c * g[..., 1]) / e2
        step = np.stack([c * g1 - s * g2, s * g1 + c * g2], -1)
        step /= np.maximum(np.abs(step).max(-1, keepdims=True) / 2.0, 1.0)
        trial = np.clip(point + step, -LOG_BOUND, LOG_BOUND)
        gain = np.abs((g * (trial - point)).sum(-1))
        done |= (gain <= 1e-13 * np.maximum(np.abs(value), 1.0)) | (damping > 1e8)
        if done.all():
            break
        v, tg, th = derivatives(trial)
        better = ~done & np.isfinite(v) & (v > value)
        point[better], value, g = trial[better], np.where(better, v, value), np.where(better[..., None], tg, g)
        haa, hab, hbb = (np.where(better, new, old) for new, old in zip(th, (haa, hab, hbb)))
        damping = np.where(better, np.maximum(damping / 10, 1e-14), np.maximum(damping * 10, 1e-10))
    rows, best = np.arange(len(curves)), value.argmax(1)
    alpha, beta = np.exp(point[rows, best]).T
    walled = (np.abs(point[rows, best]) >= LOG_BOUND).any(1)
    return pd.DataFrame({"alpha": alpha, "beta": beta, "log_likelihood": value[rows, best],
                         "success": done[rows, best], "at_bounds": walled})


@F.pandas_udf(FIT)
def _fit_curves(survivors: pd.Series) -> pd.DataFrame:
    """Alpha and beta per survivor curve; NULL curves give NULL fits."""
    usable = survivors.notna()
    out = pd.DataFrame({"alpha": np.nan, "beta": np.nan, "log_likelihood": np.nan, "success": None,
                        "at_bounds": None}, index=survivors.index, dtype=object)
    if usable.any():
        fits = _climb([np.asarray(c, float) for c in survivors[usable]])
        out.loc[usable, :] = fits.set_index(survivors.index[usable]).astype(object)
    return out.astype({"alpha": float, "beta": float, "log_likelihood": float})


def _fitted(df: DataFrame, keys, period: str, survivors: str, on_invalid: str) -> DataFrame:
    curves = prepare_survivors(df, keys, period, survivors, on_invalid)
    # The Arrow function sees broken cohorts as NULL, and runs once: its result is stored.
    usable = F.when(F.col("invalid_reason").isNull(), F.col("survivors"))
    fits = curves.withColumn("_fit", _fit_curves(usable))
    k = [field(c) for c in names(keys)]
    good = F.col("invalid_reason").isNull()
    return stored(fits.select(*k, "survivors", *[F.when(good, F.col(f"_fit.{c}")).alias(c) for c in FIT.names],
                              "invalid_reason"), "sbg-fits")


def fit_sbg(df: DataFrame, keys: str | Sequence[str] | None, period: str, survivors: str,
            on_invalid: str = "error") -> DataFrame:
    """(keys, alpha, beta, log_likelihood, success, at_bounds) per cohort, best of four starts."""
    return _fitted(df, keys, period, survivors, on_invalid).drop("survivors")


@dataclass(frozen=True)
class RetentionForecast:
    """``parameters`` with the summary figures (one row per cohort) and ``forecast`` (one per period)."""

    parameters: DataFrame
    forecast: DataFrame


def sbg_forecast(df: DataFrame, keys: str | Sequence[str] | None, period: str, survivors: str, horizon: int,
                 on_invalid: str = "error", given: tuple[float, float] | None = None) -> RetentionForecast:
    """Survival and retention per cohort for periods 0..max(horizon, last observed period).

    ``given`` (alpha, beta) applies known parameters to all cohorts instead of fitting each.
    """
    if horizon < 0:
        raise InputProblem("The forecast horizon cannot be negative.")
    if given is not None and not min(given) > 0:
        raise InputProblem("Alpha and beta must be positive.")
    k = [field(c) for c in names(keys)]
    if given is None:
        fits = _fitted(df, keys, period, survivors, on_invalid)
    else:
        known = dict(zip(("alpha", "beta"), given))
        good = F.col("invalid_reason").isNull()
        fits = prepare_survivors(df, keys, period, survivors, on_invalid).select(
            *k, "survivors", *[F.when(good, F.lit(float(known[f.name])) if f.name in known else F.lit(None)).cast(
                f.dataType).alias(f.name) for f in FIT.fields], "invalid_reason")
    s, start = F.col("survivors"), F.get("survivors", F.lit(0))
    last = F.greatest(F.lit(int(horizon)), F.size(s) - 1)
    periods = fits.where(F.col("invalid_reason").isNull()).select(
        *k, "survivors", "alpha", "beta", start.alias("_start"),
        F.explode(F.sequence(F.lit(0), last)).alias("period"))
    survival = sbg_survival(F.col("period"), "alpha", "beta")
    forecast = periods.withColumn("predicted_survival", survival).select(
        *k, "period",
        (F.get("survivors", F.col("period")) / F.col("_start")).alias("actual_survival"),
        "predicted_survival",
        F.when(F.col("period") > 0, sbg_retention("period", "alpha", "beta")).alias("predicted_retention"),
        (F.col("predicted_survival") * F.col("_start")).alias("predicted_survivors"))
    lifetime = forecast.groupBy(*k).agg(F.sum("predicted_survival").alias("forecast_expected_lifetime"))
    parameters = fits.select(
        *k, *FIT.names, "invalid_reason",
        (total(s) / start).alias("observed_expected_lifetime_lower_bound"),
        (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean_defection_probability"))
    if k:
        parameters = parameters.join(lifetime, names(keys), "left")
    else:
        parameters = parameters.withColumn("forecast_expected_lifetime", lifetime.scalar())
    return RetentionForecast(parameters, forecast)


def survival_long(forecast: DataFrame, keys: str | Sequence[str] | None = None) -> DataFrame:
    """Actual and predicted survival below each other: (keys, period, series, survival)."""
    return forecast.unpivot([*names(keys), "period"], ["actual_survival", "predicted_survival"],
                            "series", "survival")
