"""Logistic regression in which the levels of one text predictor stay in the cluster.

Normal equations of terms × terms numbers end at some thousands of terms. The 0/1 columns of one text predictor never meet,
though: their part of the Hessian is a diagonal. With d, g and b for the weights, residuals and weighted other terms of a level,
a Newton step of the other terms solves (A − Σ b b'/d) δ = r − Σ b g/d, and each level then moves by (g − b'δ)/d.
So the predictor with the most levels may have any number of them: a level is a row of a table, one pass adds up its few
numbers, and the driver solves for the other terms only. The same matrix gives exact Wald statistics of every term.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.errors import InputProblem
from patronage.scratch import discard, stored

# Most Newton steps, and the relative rise of the likelihood below which the fit ends.
STEPS, TOLERANCE = 100, 1e-11
# What a row of sums is about: a level, a row of the matrix of the other terms, or the whole table.
LEVEL, MATRIX, TOTAL = 0, 1, 2
SUMS = "kind int, key string, alpha double, sums binary"


@dataclass
class Absorbed:
    """``levels``: (level, alpha, std_error of alpha − the first level's). The rest is about the other terms."""

    levels: DataFrame
    first_alpha: float
    const: float
    const_error: float
    slopes: np.ndarray
    errors: np.ndarray
    log_likelihood: float


def _batch(kinds, keys, alphas, sums) -> pa.RecordBatch:
    return pa.record_batch([pa.array(kinds, pa.int32()), pa.array(keys, pa.string()), pa.array(alphas, pa.float64()),
                            pa.array([np.ascontiguousarray(s, np.float64).tobytes() for s in sums], pa.binary())],
                           names=["kind", "key", "alpha", "sums"])


def _pass(joined: DataFrame, beta: np.ndarray) -> DataFrame:
    """Sums of each level and of the matrix, added up batch by batch where the rows lie."""
    q = len(beta)

    def run(batches):
        matrix, total = np.zeros((q, q + 1)), np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            y, alpha = (batch.column(i).to_numpy() for i in (1, 2))
            x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, q)
            eta = np.clip(alpha + x @ beta, -500, 500)
            p = 1 / (1 + np.exp(-eta))
            w, rest = p * (1 - p), y - p
            total += [-np.logaddexp(0, np.where(y > 0, -eta, eta)).sum(), len(y)]
            matrix[:, 0] += x.T @ rest
            matrix[:, 1:] += (x * w[:, None]).T @ x
            code = batch.column(0).dictionary_encode()
            place, n = code.indices.to_numpy(), len(code.dictionary)
            sums = np.zeros((n, q + 2))
            np.add.at(sums, place, np.column_stack([w, rest, x * w[:, None]]))
            own = np.zeros(n)
            own[place] = alpha
            yield _batch([LEVEL] * n, code.dictionary.to_pylist(), own, sums)
        yield _batch([MATRIX] * q + [TOTAL], [str(i) for i in range(q)] + [""], [0.0] * (q + 1), [*matrix, total])

    return joined.select("level", "y", "alpha", "x").mapInArrow(run, SUMS)


def _merged(sums: DataFrame) -> DataFrame:
    """One row per kind and key. Rows of a key come in sequence, so a task holds one sum at a time."""
    def run(batches):
        now, alpha, held = None, 0.0, None
        done = []
        for batch in batches:
            for kind, key, a, raw in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(raw, np.float64)
                if (kind, key) == now:
                    held = held + values
                    continue
                if now is not None:
                    done.append((*now, alpha, held))
                now, alpha, held = (kind, key), a, values
            if len(done) >= 1000:
                yield _batch(*zip(*done))
                done = []
        if now is not None:
            done.append((*now, alpha, held))
        if done:
            yield _batch(*zip(*done))

    return sums.repartition("kind", "key").sortWithinPartitions("kind", "key").mapInArrow(run, SUMS)


def _corrections(state: DataFrame, q: int) -> DataFrame:
    """−Σ b g/d and −Σ b b'/d over the levels, as rows of the matrix."""
    def run(batches):
        out = np.zeros((q, q + 1))
        for batch in batches:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(batch.num_rows, q + 2)
                s = s[s[:, 0] > 0]
                b = s[:, 2:]
                out[:, 0] -= b.T @ (s[:, 1] / s[:, 0])
                out[:, 1:] -= (b / s[:, :1]).T @ b
        yield _batch([MATRIX] * q, [str(i) for i in range(q)], [0.0] * q, out)

    return state.where(F.col("kind") == LEVEL).mapInArrow(run, SUMS)


def _moved(state: DataFrame, delta: np.ndarray) -> DataFrame:
    """(level, alpha) after the step."""
    q = len(delta)

    def run(batches):
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(batch.num_rows, q + 2)
            with np.errstate(all="ignore"):
                step = np.where(s[:, 0] > 0, (s[:, 1] - s[:, 2:] @ delta) / s[:, 0], 0.0)
            yield pa.record_batch([batch.column(1), pa.array(batch.column(2).to_numpy() + step)], names=["level", "alpha"])

    return state.where(F.col("kind") == LEVEL).mapInArrow(run, "level string, alpha double")


def fit(known: DataFrame, label: str, level: Column, terms: dict[str, Column], first: str) -> Absorbed:
    """Maximum likelihood over rows with a label. ``first`` is the level that the others are compared with."""
    q = len(terms)
    x = {f"x{i}": c.cast("double") for i, c in enumerate(terms.values())}
    facts = known.agg(F.avg(label).alias("rate"), *[F.avg(c).alias(f"m{n}") for n, c in x.items()],
                      *[F.stddev_pop(c).alias(f"s{n}") for n, c in x.items()]).first()
    mean = np.array([facts[f"m{n}"] for n in x])
    scale = np.array([facts[f"s{n}"] or 1.0 for n in x])
    design = stored(known.select(level.alias("level"), F.col(label).cast("double").alias("y"), F.array(*[
        (c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(x.values(), mean, scale)]).cast("array<double>").alias("x")), "design")
    start = math.log(facts["rate"] / (1 - facts["rate"]))
    levels = design.select("level").distinct().withColumn("alpha", F.lit(start))
    beta, last, state = np.zeros(q), -math.inf, None
    for _ in range(STEPS):
        old, state = state, stored(_merged(_pass(design.join(levels, "level"), beta)), "sums")
        if old is not None:
            discard(old)
        few = state.where(F.col("kind") != LEVEL)
        found = _merged(few.unionByName(_corrections(state, q)) if q else few).collect()
        rows = {int(r["key"]): np.frombuffer(r["sums"], np.float64) for r in found if r["kind"] == MATRIX}
        matrix = np.array([rows[i] for i in range(q)]).reshape(q, q + 1)
        likelihood = float(np.frombuffer(next(r["sums"] for r in found if r["kind"] == TOTAL), np.float64)[0])
        inverse = np.linalg.pinv(matrix[:, 1:], hermitian=True) if q else np.zeros((0, 0))
        if likelihood - last <= TOLERANCE * abs(likelihood):
            break
        delta = inverse @ matrix[:, 0]
        levels, beta, last = _moved(state, delta), beta + delta, likelihood
    else:
        raise InputProblem(f"The likelihood still rises after {STEPS} steps.", "A term may separate the responses.")
    own = state.where((F.col("kind") == LEVEL) & (F.col("key") == first)).first()
    s = np.frombuffer(own["sums"], np.float64)
    offset, first_alpha = mean / scale, float(own["alpha"])
    u = s[2:] / s[0]
    wide = u + offset

    def run(batches):
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(batch.num_rows, q + 2)
            gap = v[:, 2:] / v[:, :1] - u
            error = np.sqrt(1 / v[:, 0] + 1 / s[0] + np.einsum("ij,jk,ik->i", gap, inverse, gap))
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(error)], names=["level", "alpha", "std_error"])

    table = stored(state.where(F.col("kind") == LEVEL).mapInArrow(run, "level string, alpha double, std_error double"), "levels")
    discard(design)
    return Absorbed(table, first_alpha, first_alpha - float(beta @ offset), math.sqrt(1 / s[0] + wide @ inverse @ wide),
                    beta / scale, np.sqrt(np.diag(inverse)) / scale, likelihood)
