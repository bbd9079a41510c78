"""Fitting BG/BB by distributed maximum likelihood, and scoring every customer."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import invalid_reason, require_distinct_roles
from patronage.errors import InputProblem
from patronage.functions.bgbb import (
    bgbb_expected_purchases,
    bgbb_log_likelihood,
    bgbb_probability_alive,
    bgbb_rules,
)
from patronage.functions.parse import number_column
from patronage.plans.newton import Derivatives, maximise, points_column
from patronage.scratch import stored

# Bounds of the log parameters, and the four starts (alpha, beta, gamma, delta).
LOG_BOUNDS = (-12.0, 12.0)
STARTS = ((1.2, 0.8, 0.7, 2.8), (1.0, 1.0, 1.0, 3.0), (2.0, 2.0, 0.5, 2.0), (0.5, 2.0, 2.0, 5.0))
PARAMETERS = ("alpha", "beta", "gamma", "delta")
# Step of the central differences, in log parameters.
STEP = 1e-3
# Distinct histories up to which they are joined back by broadcast (40 bytes each).
BROADCAST_HISTORIES = 500_000


@dataclass(frozen=True)
class BGBBFit:
    """Beta(alpha, beta) purchase and Beta(gamma, delta) dropout probabilities."""

    alpha: float
    beta: float
    gamma: float
    delta: float
    log_likelihood: float
    success: bool
    at_bounds: bool = False  # a parameter lies on the wall of its box: the data do not pin it down

    def to_dict(self) -> dict:
        return asdict(self)


def read_histories(df: DataFrame, n: str, tx: str, x: str, weight: str | None = None) -> DataFrame:
    """n, tx, x as whole numbers (cut, not rounded); rows that lack one are dropped."""
    require_distinct_roles({"periods n": n, "last purchase tx": tx, "purchases x": x, "weight": weight})
    w = F.lit(1.0) if weight is None else F.coalesce(number_column(df, weight), F.lit(0.0))
    whole = {k: number_column(df, c).try_cast("int") for k, c in (("_n", n), ("_tx", tx), ("_x", x))}
    rows = df.withColumns({**whole, "_w": w})
    return rows.where(F.col("_n").isNotNull() & F.col("_tx").isNotNull() & F.col("_x").isNotNull())


def compressed_histories(rows: DataFrame) -> DataFrame:
    """Distinct (n, tx, x) with their weight, checked: at most about n²/2 rows per n, for any number of customers."""
    histories = stored(rows.groupBy("_n", "_tx", "_x").agg(
        F.sum("_w").alias("weight"), F.min("_w").alias("least_weight")), "bgbb-histories")
    reason = invalid_reason([*bgbb_rules("_n", "_tx", "_x"),
                             (F.col("least_weight") >= 0, "weights must not be negative")])
    found = histories.agg(F.count("*").alias("rows"), F.max(reason).alias("reason")).first()
    if not found["rows"]:
        raise InputProblem("No row has n, tx and x.")
    if found["reason"]:
        raise InputProblem(f"The histories cannot be used: {found['reason']}.")
    return histories


def _stencil(size: int) -> list[np.ndarray]:
    """Offsets of central differences: the point, two per axis, four per pair of axes."""
    unit = np.eye(size)
    points = [np.zeros(size)]
    for i in range(size):
        points += [unit[i], -unit[i]]
    for i, j in combinations(range(size), 2):
        points += [unit[i] + unit[j], unit[i] - unit[j], -unit[i] + unit[j], -unit[i] - unit[j]]
    return points


def _from_stencil(values: np.ndarray, size: int) -> Derivatives:
    centre, axis, cross = values[0], values[1:1 + 2 * size], values[1 + 2 * size:]
    up, down = axis[0::2], axis[1::2]
    gradient = (up - down) / (2 * STEP)
    hessian = np.diag((up - 2 * centre + down) / STEP**2)
    for k, (i, j) in enumerate(combinations(range(size), 2)):
        pp, pm, mp, mm = cross[4 * k:4 * k + 4]
        hessian[i, j] = hessian[j, i] = (pp - pm - mp + mm) / (4 * STEP**2)
    return float(centre), gradient, hessian


class _Likelihood:
    """Σ w·ln L and its differences for several points in one aggregation over the distinct histories.

    The points enter as one exploded array literal, so plan and generated code do not change between
    passes; each task sends one partial sum per point.
    """

    def __init__(self, histories: DataFrame):
        self.histories = histories.select("_n", "_tx", "_x", "weight")
        self.stencil = _stencil(4)
        self.total = F.sum(F.col("weight") * bgbb_log_likelihood("_n", "_tx", "_x", *PARAMETERS)).alias("value")

    def __call__(self, logs: np.ndarray) -> list[Derivatives]:
        points = [np.exp(v + STEP * offset) for v in logs for offset in self.stencil]
        rows = self.histories.select("*", points_column(PARAMETERS, points))
        found = {r["point"]: r["value"] for r in rows.groupBy("point").agg(self.total).collect()}
        values = np.array([found[i] for i in range(len(points))]).reshape(len(logs), len(self.stencil))
        return [_from_stencil(v, 4) for v in values]


def _fit(histories: DataFrame) -> BGBBFit:
    best = maximise(_Likelihood(histories), [np.log(s) for s in STARTS], [LOG_BOUNDS[0]] * 4, [LOG_BOUNDS[1]] * 4)
    alpha, beta, gamma, delta = (float(v) for v in np.exp(best.point))
    return BGBBFit(alpha, beta, gamma, delta, best.value, best.converged, best.at_bounds)


def fit_bgbb(df: DataFrame, n: str = "n", tx: str = "tx", x: str = "x", weight: str | None = None) -> BGBBFit:
    """Parameters that maximise the (weighted) likelihood of the histories, best of four starts."""
    return _fit(compressed_histories(read_histories(df, n, tx, x, weight)))


def score_bgbb(df: DataFrame, n: str = "n", tx: str = "tx", x: str = "x", future_periods: int = 5,
               weight: str | None = None) -> tuple[BGBBFit, DataFrame]:
    """The fit, and every row with a usable history with probability_alive and expected_future_purchases."""
    if future_periods < 0:
        raise InputProblem("Future periods cannot be negative.")
    rows = read_histories(df, n, tx, x, weight)
    histories = compressed_histories(rows)
    fit = _fit(histories)
    theta = (fit.alpha, fit.beta, fit.gamma, fit.delta)
    scores = {"probability_alive": bgbb_probability_alive("_n", "_tx", "_x", *theta),
              "expected_future_purchases": bgbb_expected_purchases("_n", "_tx", "_x", future_periods, *theta)}
    # Equal histories have equal scores: computed once each and looked up by every customer. The table has been written,
    # so Spark knows its size and chooses the join; a history that many customers share is split by adaptive execution.
    table = histories.select("_n", "_tx", "_x").withColumns(scores)
    scored = rows.join(table, ["_n", "_tx", "_x"])
    return fit, scored.drop("_n", "_tx", "_x", "_w")
