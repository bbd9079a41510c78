"""The analyses as users run them: from a table to all of its result tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from patronage.functions.parse import binary_column
from patronage.operators.prep import coerce_binary, require_numbers
from patronage.operators.ranking import lift_table, rfm_scores
from patronage.operators.summaries import When, bgnbd_summary, rfm_from_transactions
from patronage.operators.targeting import segment_response, targeting_profit, targeting_summary
from patronage.plans.bgnbd import BGNBDFit, score_bgnbd
from patronage.plans.holdout import HeldOut, held_out
from patronage.plans.response_models import PREDICTED, LogisticModel, TreeModel, fit_decision_tree, fit_logistic
from patronage.scratch import stored


@dataclass(frozen=True)
class RFMResult:
    scores: DataFrame
    segments: DataFrame


def rfm_analysis(df: DataFrame, customer: str, recency: str, frequency: str, monetary: str,
                 response: str | None = None, groups: int = 5, nested: bool = True) -> RFMResult:
    """Scores per customer and the segments they form, from a customer table."""
    require_numbers(df, {recency: "recency", frequency: "frequency", monetary: "monetary value"})
    if response is not None:
        df = coerce_binary(df, response, "response (0/1)")
    scores = rfm_scores(df, recency, frequency, monetary, customer, groups, nested)
    return RFMResult(scores, segment_response(scores, "RFM_segment", response).orderBy("RFM_segment"))


def rfm_from_log(df: DataFrame, customer: str, date: str, amount: str, observation_date: When = None,
                 groups: int = 5, nested: bool = True) -> RFMResult:
    """Scores and segments straight from a purchase log."""
    inputs = rfm_from_transactions(df, customer, date, amount, observation_date)
    scores = rfm_scores(inputs, "recency_days", "frequency_per_month", "monetary_average", customer, groups, nested)
    return RFMResult(scores, segment_response(scores).orderBy("RFM_segment"))


@dataclass(frozen=True)
class TargetingResult:
    """``scores`` per customer, ``summary`` and ``lift`` of the campaign, and the fitted ``model``.

    Profit and lift are those of the rows the model was fitted on (in-sample). ``held_out`` has the same figures from models
    that have not seen the customers they score, if folds were asked for.
    """

    scores: DataFrame
    summary: DataFrame
    lift: DataFrame
    model: LogisticModel | TreeModel
    held_out: HeldOut | None = None


def targeting_analysis(df: DataFrame, customer: str, outcome: str, predictors: Sequence[str],
                       profit_if_response: float, profit_if_no_response: float, method: str = "logistic",
                       groups: int = 10, folds: int | None = None, **tree_options) -> TargetingResult:
    """From a customer table with a 0/1 response to the customers worth contacting.

    With ``folds`` the result also has held-out profit and lift, for one more fit per fold.
    """
    answered = df.withColumn(outcome, binary_column(df, outcome))
    model = fit_logistic(answered, outcome, predictors) if method == "logistic" \
        else fit_decision_tree(answered, outcome, predictors, **tree_options)
    scores = targeting_profit(model.scored, outcome, PREDICTED, profit_if_response, profit_if_no_response)
    summary = targeting_summary(scores, outcome, profit_if_response, profit_if_no_response)
    unseen = held_out(answered, customer, outcome, predictors, profit_if_response, profit_if_no_response, method, groups,
                      folds, **tree_options) if folds else None
    return TargetingResult(scores, summary, lift_table(model.scored, outcome, PREDICTED, customer, groups), model, unseen)


def bgnbd_from_log(df: DataFrame, customer: str, date: str, horizon: float, end: When = None,
                   unit: str = "weeks") -> tuple[BGNBDFit, DataFrame]:
    """BG/NBD fit and scores straight from a purchase log.

    The summary is written, so that fitting and scoring read it and not the log again.
    """
    return score_bgnbd(stored(bgnbd_summary(df, customer, date, end, unit), "summary"), horizon=horizon)
