"""Maximum likelihood with Spark doing the sums.

The driver holds a handful of parameter points and, per pass, one sum of values and derivatives per
point. All starts advance together, so a pass over the data serves every one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Value, gradient and Hessian of the objective at one point.
Derivatives = tuple[float, np.ndarray, np.ndarray]
Evaluate = Callable[[np.ndarray], list[Derivatives]]

LONGEST_STEP = 2.0


@dataclass
class Optimum:
    point: np.ndarray
    value: float
    converged: bool
    at_bounds: bool
    passes: int


class _Climber:
    """One start on its way up: damped Newton steps inside a box."""

    def __init__(self, start, low, high):
        self.low, self.high = low, high
        self.point = np.clip(np.asarray(start, float), low, high)
        self.value, self.gradient, self.hessian = -np.inf, None, None
        self.damping, self.done = 1e-3, False
        self.trial, self.gain = self.point, np.inf

    def propose(self, tolerance: float) -> None:
        if self.gradient is None:
            return
        g = self.gradient
        held = ((self.point <= self.low) & (g < 0)) | ((self.point >= self.high) & (g > 0))
        free = ~held
        step = np.zeros_like(g)
        if free.any():
            # Directions of negative curvature are turned uphill instead of followed down.
            bends, axes = np.linalg.eigh(-self.hessian[np.ix_(free, free)])
            scale = max(np.abs(bends).max(), 1e-300)
            bends = np.maximum(np.abs(bends), 1e-12 * scale) + self.damping * scale
            step[free] = axes @ ((axes.T @ g[free]) / bends)
        longest = np.abs(step).max()
        if longest > LONGEST_STEP:
            step *= LONGEST_STEP / longest
        # Shorten the whole step at the wall of the box, so that it keeps its direction.
        room = np.where(step > 0, self.high - self.point, self.low - self.point)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(step != 0, room / step, np.inf).min()
        self.trial = np.clip(self.point + min(reach, 1.0) * step, self.low, self.high)
        self.gain = float(abs(g @ (self.trial - self.point)))
        self.done = self.gain <= tolerance * max(1.0, abs(self.value))

    def receive(self, value: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        sound = np.isfinite(value) and np.isfinite(gradient).all() and np.isfinite(hessian).all()
        if sound and value > self.value:
            self.point, self.value, self.gradient, self.hessian = self.trial, value, gradient, hessian
            self.damping = max(self.damping / 10, 1e-14)
        elif self.gradient is None:
            self.done = True  # the start itself cannot be evaluated
        else:
            self.damping = max(self.damping * 10, 1e-10)
            self.done = self.damping > 1e6


def maximise(evaluate: Evaluate, starts: Sequence[Sequence[float]], low: Sequence[float],
             high: Sequence[float], tolerance: float = 1e-9, max_passes: int = 100) -> Optimum:
    """The best optimum over all starts; ``evaluate`` serves many points in one pass over the data."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    climbers = [_Climber(s, low, high) for s in starts]
    passes = 0
    while passes < max_passes:
        for c in climbers:
            if not c.done:
                c.propose(tolerance)
        active = [c for c in climbers if not c.done]
        if not active:
            break
        for c, found in zip(active, evaluate(np.array([c.trial for c in active]))):
            c.receive(*found)
        passes += 1
    best = max(climbers, key=lambda c: c.value)
    at_bounds = bool(np.any((best.point <= low) | (best.point >= high)))
    return Optimum(best.point, float(best.value), bool(best.done and np.isfinite(best.value)), at_bounds, passes)


def points_column(names: Sequence[str], points: Sequence[Sequence[float]]) -> Column:
    """Parameter points as rows (``point`` = 0, 1, ..., then one column per name), to be selected.

    One array literal is unrolled next to every data row. Being a literal, it leaves the plan and the
    generated code the same from pass to pass.
    """
    def struct(i: int, values: Sequence[float]) -> str:
        cells = ", ".join(f"'{n}', {float(v)!r}D" for n, v in zip(names, values))
        return f"named_struct('point', {i}, {cells})"

    return F.inline(F.expr(f"array({', '.join(struct(i, p) for i, p in enumerate(points))})"))
