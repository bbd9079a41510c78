"""Fitting BG/NBD by distributed maximum likelihood, and scoring every customer."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import guarded, invalid_reason, require_distinct_roles
from patronage.errors import InputProblem
from patronage.functions.bgnbd import bgnbd_rules, expected_if_active, probability_active
from patronage.functions.parse import number_column
from patronage.functions.special import (
    DIGAMMA_SERIES,
    SHIFT,
    TRIGAMMA_SERIES,
    digamma,
    log_gamma,
    trigamma,
)
from patronage.plans.newton import Derivatives, maximise, points_column
from patronage.scratch import stored

# Bounds of the log parameters, and the four starts as (r, alpha per median T, a, b).
LOG_BOUNDS = (-12.0, 16.0)
STARTS = ((0.5, 1 / 2, 1.5, 3.0), (1.0, 1.0, 2.0, 4.0), (0.2, 1 / 10, 0.8, 2.0), (2.0, 2.0, 3.0, 3.0))
SHORTEST_MEDIAN = 1e-3
# Fixed value: how far below zero rounding may push an expectation.
BELOW_ZERO = -1e-8


@dataclass(frozen=True)
class BGNBDFit:
    """Gamma(r, alpha) purchase rates and Beta(a, b) dropout probabilities."""

    r: float
    alpha: float
    a: float
    b: float
    log_likelihood: float
    success: bool
    at_bounds: bool = False  # a parameter lies on the wall of its box: the data do not pin it down

    def to_dict(self) -> dict:
        return asdict(self)


def read_histories(df: DataFrame, x: str, tx: str, T: str, weight: str | None = None) -> DataFrame:
    """x, tx, T (and weight) as doubles; rows in which one of the three is not a finite number are dropped."""
    require_distinct_roles({"repeat purchases x": x, "last purchase tx": tx, "observation length T": T,
                            "weight": weight})
    top = F.lit(float("inf"))
    w = F.lit(1.0) if weight is None else F.coalesce(number_column(df, weight), F.lit(0.0))
    rows = df.withColumns({"_x": number_column(df, x), "_tx": number_column(df, tx),
                           "_T": number_column(df, T), "_w": w})
    return rows.where((F.abs("_x") < top) & (F.abs("_tx") < top) & (F.abs("_T") < top))


def compressed_histories(rows: DataFrame) -> DataFrame:
    """Distinct histories with their summed weight, computed once; this is all a fit reads again."""
    return stored(rows.groupBy("_x", "_tx", "_T").agg(
        F.sum("_w").alias("weight"), F.min("_w").alias("least_weight"), F.count("*").alias("customers")),
        "bgnbd-histories")


def validate_bgnbd(histories: DataFrame) -> float:
    """One pass over the distinct histories: the median T of the customers, or an error for a broken rule."""
    reason = invalid_reason([*bgnbd_rules("_x", "_tx", "_T"),
                             (F.col("least_weight") >= 0, "weights must not be negative")])
    found = histories.agg(
        F.count("*").alias("rows"), F.max(reason).alias("reason"),
        F.percentile("_T", F.lit(0.5), F.col("customers")).alias("median")).first()
    if not found["rows"]:
        raise InputProblem("No row has a finite x, tx and T.")
    if found["reason"]:
        raise InputProblem(f"The histories cannot be used: {found['reason']}.")
    return found["median"]


class _Likelihood:
    """Σ w·ln L with exact first and second derivatives, for several points in one aggregation.

    ln L splits in two. The Gamma-function part depends on x alone, so it is summed over the histogram
    of x. The rest, ln(e^u + e^v), needs logarithms only and is summed over the histories, with
    u = −(r+x) ln(α+T) and v = ln a − ln(b+x−1) − (r+x) ln(α+tx). Both live in one table, so a pass
    is one job. The points enter as one array literal that is exploded: the plan and the generated
    code stay the same from pass to pass, and partial sums leave each task as one row per point.
    """

    def __init__(self, histories: DataFrame):
        histogram = stored(histories.groupBy("_x").agg(F.sum("weight").alias("count")), "bgnbd-histogram")
        none = F.lit(None).cast("double")
        self.table = histories.select("_x", "_tx", "_T", "weight", none.alias("count")).unionByName(
            histogram.select("_x", none.alias("_tx"), none.alias("_T"), none.alias("weight"), "count"))
        self.steps, self.sums = self._steps(), self._sums()
        self.weight = histogram.agg(F.sum("count")).first()[0]

    @staticmethod
    def _steps() -> list[dict[str, Column]]:
        """What each history contributes, in columns that build on one another."""
        x, w, never = F.col("_x"), F.col("weight"), F.lit(0.0)
        # No logarithm exists for a fractional x with b+x < 1: NaN makes the optimiser reject the point.
        odds = F.coalesce(F.log(F.col("a") * -F.col("v_b")), F.lit(float("nan")))
        return [
            {"rx": F.col("r") + x, "end": F.col("alpha") + F.col("_T"), "last": F.col("alpha") + F.col("_tx"),
             "v_a": F.when(x > 0, 1 / F.col("a")).otherwise(never),
             "v_b": F.when(x > 0, -1 / (F.col("b") + x - 1)).otherwise(never)},
            {"log_T": F.log("end"), "log_tx": F.log("last")},
            {"gap": F.when(x > 0, F.col("rx") * (F.col("log_T") - F.col("log_tx")) + odds)},
            {"p": F.when(x > 0, 1 / (1 + F.exp(-F.col("gap")))).otherwise(never),
             # ln(e^u + e^v) = u + ln(1 + e^(v−u)), in the form that does not overflow.
             "mix": -F.col("rx") * F.col("log_T") + F.coalesce(
                 F.greatest(F.col("gap"), never) + F.log1p(F.exp(-F.abs("gap"))), never),
             # Derivatives of u and v by r are −ln(α+T) and −ln(α+tx), by alpha these two:
             "u_al": -F.col("rx") / F.col("end"), "v_al": -F.col("rx") / F.col("last")},
            # Weight of having dropped out and of not, their product, and the differences of derivatives.
            {"wp": w * F.col("p"), "wq": w * (1 - F.col("p")), "ws": w * F.col("p") * (1 - F.col("p")),
             "d_r": F.col("log_T") - F.col("log_tx"), "d_al": F.col("v_al") - F.col("u_al")},
            {"s_r": F.col("ws") * F.col("d_r"), "s_al": F.col("ws") * F.col("d_al"),
             "s_a": F.col("ws") * F.col("v_a"), "s_b": F.col("ws") * F.col("v_b")},
        ]

    @staticmethod
    def _sums() -> list[Column]:
        c = F.col
        n, x = c("count"), c("_x")
        wp, wq = c("wp"), c("wq")
        sums = {
            "mix": c("weight") * c("mix"),
            "g_r": -wq * c("log_T") - wp * c("log_tx"), "g_al": wq * c("u_al") + wp * c("v_al"),
            "g_a": wp * c("v_a"), "g_b": wp * c("v_b"),
            "h_r_r": c("s_r") * c("d_r"),
            # u and v also bend themselves: d2u/dr dα = −1/(α+T), d2u/dα2 = (r+x)/(α+T)^2, and so for v.
            "h_r_al": c("s_r") * c("d_al") - wq / c("end") - wp / c("last"),
            "h_al_al": c("s_al") * c("d_al") - wq * c("u_al") / c("end") - wp * c("v_al") / c("last"),
            "h_r_a": c("s_r") * c("v_a"), "h_r_b": c("s_r") * c("v_b"),
            "h_al_a": c("s_al") * c("v_a"), "h_al_b": c("s_al") * c("v_b"),
            "h_a_a": (c("s_a") - wp * c("v_a")) * c("v_a"), "h_a_b": c("s_a") * c("v_b"),
            "h_b_b": (c("s_b") + wp * c("v_b")) * c("v_b"),
            "gamma": n * (log_gamma(c("r") + x) + log_gamma(c("b") + x) - log_gamma(c("ab") + x)),
        }
        for name in ("r", "b", "ab"):
            sums[f"psi_{name}"] = n * digamma(c(name) + x)
            sums[f"tri_{name}"] = n * trigamma(c(name) + x)
        # Rows of the histogram have no weight and rows of the histories no count: NULL adds nothing.
        return [F.sum(value).alias(name) for name, value in sums.items()]

    def __call__(self, logs: np.ndarray) -> list[Derivatives]:
        points = [np.exp(v) for v in logs]
        literal = points_column(("r", "alpha", "a", "b", "ab"), [(*p, p[2] + p[3]) for p in points])
        rows = self.table.select("_x", "_tx", "_T", "weight", "count", literal)
        for step in self.steps:
            rows = rows.withColumns(step)
        found = {r["point"]: r for r in rows.groupBy("point").agg(*self.sums).collect()}
        return [self._derivatives(point, found[i]) for i, point in enumerate(points)]

    def _derivatives(self, point: np.ndarray, s) -> Derivatives:
        r, al, a, b = point
        W = self.weight
        (l_r, d_r, t_r), (l_b, d_b, t_b), (l_ab, d_ab, t_ab) = (_gamma_terms(z) for z in (r, b, a + b))
        value = s["mix"] + s["gamma"] + W * (r * math.log(al) - l_r - l_b + l_ab)
        by_ab, bend_ab = W * d_ab - s["psi_ab"], W * t_ab - s["tri_ab"]
        g = np.array([
            s["g_r"] + s["psi_r"] - W * d_r + W * math.log(al),
            s["g_al"] + W * r / al,
            s["g_a"] + by_ab,
            s["g_b"] + by_ab + s["psi_b"] - W * d_b,
        ])
        h = np.array([
            [s["h_r_r"] + s["tri_r"] - W * t_r, s["h_r_al"] + W / al, s["h_r_a"], s["h_r_b"]],
            [0, s["h_al_al"] - W * r / al**2, s["h_al_a"], s["h_al_b"]],
            [0, 0, s["h_a_a"] + bend_ab, s["h_a_b"] + bend_ab],
            [0, 0, 0, s["h_b_b"] + bend_ab + s["tri_b"] - W * t_b],
        ])
        h = h + np.triu(h, 1).T
        # In log parameters: d/dφ = θ·d/dθ.
        return value, point * g, np.outer(point, point) * h + np.diag(point * g)


def _gamma_terms(z: float) -> tuple[float, float, float]:
    """ln Γ, digamma and trigamma of one number, with the series of the column versions."""
    y = z + SHIFT
    s = 1 / (y * y)
    psi = math.log(y) - 0.5 / y - s * np.polyval(DIGAMMA_SERIES[::-1], s) - sum(1 / (z + k) for k in range(SHIFT))
    tri = 1 / y + 0.5 * s + s / y * np.polyval(TRIGAMMA_SERIES[::-1], s) \
        + sum(1 / (z + k) ** 2 for k in range(SHIFT))
    return math.lgamma(z), float(psi), float(tri)


def _fit(rows: DataFrame) -> BGNBDFit:
    histories = compressed_histories(rows)
    median = max(validate_bgnbd(histories), SHORTEST_MEDIAN)
    starts = [np.log([r, share * median, a, b]) for r, share, a, b in STARTS]
    best = maximise(_Likelihood(histories), starts, [LOG_BOUNDS[0]] * 4, [LOG_BOUNDS[1]] * 4)
    r, alpha, a, b = (float(v) for v in np.exp(best.point))
    return BGNBDFit(r, alpha, a, b, best.value, best.converged, best.at_bounds)


def fit_bgnbd(df: DataFrame, x: str = "x", tx: str = "tx", T: str = "T", weight: str | None = None) -> BGNBDFit:
    """Parameters that maximise the (weighted) likelihood of the histories, best of four starts."""
    return _fit(read_histories(df, x, tx, T, weight))


def bgnbd_expected_purchases(df: DataFrame, horizon: float, fit: BGNBDFit, x: str = "x", tx: str = "tx",
                             T: str = "T", on_invalid: str = "error") -> DataFrame:
    """Adds probability_active, expected_if_active and expected_future_purchases over ``horizon``."""
    if horizon < 0:
        raise InputProblem("The future horizon cannot be negative.")
    theta = (fit.r, fit.alpha, fit.a, fit.b)
    rules = bgnbd_rules(x, tx, T)
    alive = guarded(probability_active(x, tx, T, *theta), rules, on_invalid)
    if horizon == 0:
        zero = F.when(F.col("probability_active").isNotNull(), F.lit(0.0))
        return df.withColumn("probability_active", alive).withColumns(
            {"expected_if_active": zero, "expected_future_purchases": zero})
    raw = df.withColumns({"probability_active": alive,
                          "_active": expected_if_active(x, T, horizon, *theta)})
    expected = F.col("probability_active") * F.col("_active")
    top = F.lit(float("inf"))
    steady = [*rules, (~F.isnan(expected) & (F.abs(expected) < top) & (expected >= BELOW_ZERO),
                       "the expectation is unstable for these parameters")]
    zero = F.lit(0.0)
    return raw.withColumns({
        "expected_if_active": guarded(F.greatest(F.col("_active"), zero), steady, on_invalid),
        "expected_future_purchases": guarded(F.greatest(expected, zero), steady, on_invalid),
    }).drop("_active")


def score_bgnbd(df: DataFrame, x: str = "x", tx: str = "tx", T: str = "T", horizon: float = 39.0,
                weight: str | None = None) -> tuple[BGNBDFit, DataFrame]:
    """The fit, and every row with a usable history with its three scores."""
    rows = read_histories(df, x, tx, T, weight)
    fit = _fit(rows)
    scored = bgnbd_expected_purchases(rows, horizon, fit, "_x", "_tx", "_T")
    return fit, scored.drop("_x", "_tx", "_T", "_w")
