"""Exact medians of any number of columns, without sorting and without one large buffer."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.parse import number_column

# Values that are left when the search ends; this many per column and rank are held and sorted at last.
HANDFUL = 100
# How far around the wanted rank the two pivots lie, and the sketch size that makes them likely.
SLACK, SKETCH = 1e-3, 10_000


@dataclass
class _Search:
    """The value at one rank of one column; it lies strictly between ``low`` and ``high``."""

    value: Column
    rank: int
    inside: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf
    answer: float | None = None

    def within(self) -> Column:
        inside = self.value.isNotNull()
        if self.low > -math.inf:
            inside = inside & (self.value > self.low)
        if self.high < math.inf:
            inside = inside & (self.value < self.high)
        return F.when(inside, self.value)

    def narrow(self, pivots: Sequence[float], counts: Sequence[int]) -> None:
        """Continue on the side of the pivots the rank lies on; a pivot itself may be the answer."""
        (first, second), (under_first, to_first, under_second, to_second) = pivots, counts
        if self.rank <= under_first:
            self.high, self.inside = first, under_first - self.below
        elif self.rank <= to_first:
            self.answer = first
        elif self.rank <= under_second:
            self.low, self.high = first, second
            self.below, self.inside = to_first, under_second - to_first
        elif self.rank <= to_second:
            self.answer = second
        else:
            self.low, self.inside = second, self.inside + self.below - to_second
            self.below = to_second


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Median per column, the two middle values averaged, missing values left out.

    Each round is two aggregations over all columns at once: a sketch proposes two pivots around the
    middle, and counts say on which side of them it lies. A round cuts the candidates several hundred
    times, down to a handful, so nothing that is held grows with the table.
    """
    if not columns:
        return {}
    values = {c: number_column(df, c) for c in columns}
    rows = df.select(*[v.alias(f"_{i}") for i, v in enumerate(values.values())])
    sizes = rows.agg(*[F.count(F.col(c)).alias(c) for c in rows.columns]).first()
    searches: dict[str, list[_Search]] = {}
    for i, name in enumerate(columns):
        n = sizes[f"_{i}"]
        middle = sorted({(n + 1) // 2, n // 2 + 1}) if n else []
        searches[name] = [_Search(F.col(f"_{i}"), rank, n) for rank in middle]
    everything = [s for both in searches.values() for s in both]

    while wide := [s for s in everything if s.answer is None and s.inside > HANDFUL]:
        def around(s: _Search) -> list[float]:
            share = (s.rank - s.below) / s.inside
            return [max(share - SLACK, 0.0), min(share + SLACK, 1.0)]

        pivots = rows.agg(*[F.percentile_approx(s.within(), around(s), SKETCH) for s in wide]).first()
        counts = rows.agg(F.array(*[
            F.array(F.count_if(s.value < lo), F.count_if(s.value <= lo),
                    F.count_if(s.value < hi), F.count_if(s.value <= hi))
            for s, (lo, hi) in zip(wide, pivots)])).first()[0]
        for s, pivot, count in zip(wide, pivots, counts):
            s.narrow(pivot, count)

    few = [s for s in everything if s.answer is None]
    if few:
        at = [(s.rank - s.below - 1) / max(s.inside - 1, 1) for s in few]
        exact = rows.agg(*[F.percentile(s.within(), F.lit(p)) for s, p in zip(few, at)]).first()
        for s, found in zip(few, exact):
            s.answer = found
    return {c: sum(s.answer for s in both) / len(both) if both else None for c, both in searches.items()}
