"""Scores of customers by models that have not seen them.

Every customer belongs to one of a few folds by a hash of its key, the same in every run. The model that scores a
fold is fitted on the other folds only, so profit and lift of the scores are held-out figures.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.functions.parse import binary_column
from patronage.operators.ranking import lift_table
from patronage.operators.targeting import targeting_profit, targeting_summary
from patronage.plans.response_models import PREDICTED, fit_decision_tree, fit_logistic
from patronage.scratch import stored

FOLDS = 5
MASKED = "_seen_outcome"


def fold_of(key: Column, folds: int = FOLDS, seed: str = "") -> Column:
    """Fold 0 .. folds − 1 of a key: the first 32 bits of the MD5 of ``seed:key``. Missing keys share a fold."""
    if folds < 2:
        raise InputProblem("There must be at least two folds.")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def out_of_fold(df: DataFrame, customer: str, outcome: str, predictors: Sequence[str], method: str = "logistic",
                folds: int = FOLDS, seed: str = "", **options) -> DataFrame:
    """(customer, outcome, predictors, fold, predicted_probability): each fold scored by the model of the others.

    Rows without an outcome take no part in any fit and are scored like the rest of their fold. The needed columns are
    written once; there is one fit per fold.
    """
    fits = {"logistic": fit_logistic, "tree": fit_decision_tree}
    if method not in fits:
        raise InputProblem("method must be 'logistic' or 'tree'.")
    columns = list(dict.fromkeys([customer, outcome, *predictors]))
    require_columns(df, *columns)
    rows = stored(df.select(*map(field, columns), fold_of(field(customer), folds, seed).alias("fold")), "folds")
    parts = []
    for k in range(folds):
        seen = rows.withColumn(MASKED, F.when(F.col("fold") != k, binary_column(rows, outcome)))
        model = fits[method](seen, MASKED, predictors, everyone=True, **options)
        parts.append(model.scored.where(F.col("fold") == k).select(*map(field, columns), "fold", PREDICTED))
    return functools.reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class HeldOut:
    """Out-of-fold ``scores`` per customer with target and profits, their ``summary``, and ``lift`` by group."""

    scores: DataFrame
    summary: DataFrame
    lift: DataFrame


def held_out(df: DataFrame, customer: str, outcome: str, predictors: Sequence[str], profit_if_response: float,
             profit_if_no_response: float, method: str = "logistic", groups: int = 10, folds: int = FOLDS, seed: str = "",
             **options) -> HeldOut:
    """Held-out profit and lift of a campaign; rows without an outcome count in neither."""
    scored = stored(out_of_fold(df, customer, outcome, predictors, method, folds, seed, **options), "held-out")
    answered = scored.where(binary_column(scored, outcome).isNotNull())
    scores = targeting_profit(answered, outcome, PREDICTED, profit_if_response, profit_if_no_response)
    return HeldOut(scores, targeting_summary(scores, outcome, profit_if_response, profit_if_no_response),
                   lift_table(answered, outcome, PREDICTED, customer, groups))
