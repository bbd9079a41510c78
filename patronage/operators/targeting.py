"""Segments, splits and profit of a campaign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, names, require_columns
from patronage.errors import InputProblem
from patronage.functions.parse import binary_column, no_nan, number_column
from patronage.functions.value import break_even_probability


def segment_response(df: DataFrame, segment: str = "RFM_segment", response: str | None = None) -> DataFrame:
    """Customers per segment and, with a 0/1 response, their response rate and responses."""
    totals = [F.count("*").alias("customers")]
    if response is not None:
        answer = binary_column(df, response)
        totals += [F.avg(answer).alias("response_rate"),
                   F.coalesce(F.sum(answer), F.lit(0.0)).alias("responses")]
    return df.where(field(segment).isNotNull()).groupBy(field(segment)).agg(*totals)


def split_gini_from_groups(groups: DataFrame, size: str, responders: str,
                           keys: str | Sequence[str] | None = None, on_invalid: str = "error") -> DataFrame:
    """Size-weighted impurity of ready-made groups (one row per group of a split)."""
    n, r = field(size).cast("double"), field(responders).cast("double")
    bad = F.count_if(~F.coalesce((n > 0) & (r >= 0) & (r <= n), F.lit(False)))
    # Sum of (n/N)·2·(r/n)(1−r/n) = 2/N · sum of r(n−r)/n.
    out = groups.groupBy(*map(field, names(keys))).agg(
        bad.alias("_bad"),
        (2 * F.sum(r * (n - r) / F.when(n > 0, n)) / F.sum(n)).alias("weighted_gini"))
    if on_invalid == "error":
        message = F.lit("each group needs a positive size and responders between 0 and its size")
        gini = F.when(F.col("_bad") == 0, F.col("weighted_gini")).otherwise(F.raise_error(message))
    else:
        gini = F.when(F.col("_bad") == 0, F.col("weighted_gini"))
    return out.withColumn("weighted_gini", gini).drop("_bad")


def weighted_split_gini(df: DataFrame, splits: Sequence[str], response: str) -> DataFrame:
    """Impurity of every candidate split column, all in one pass: (split, groups, weighted_gini).

    Lower means the split tells responders from others better. Rows without a response are left out;
    rows without a split value form a group of their own.
    """
    if not splits:
        raise InputProblem("No split column was given.")
    require_columns(df, *splits)
    answered = df.select(binary_column(df, response).alias("_response"), *[
        field(c).cast("string").alias(f"_s{i}") for i, c in enumerate(splits)
    ]).where(F.col("_response").isNotNull())
    pairs = answered.select("_response", F.explode(F.array(*[
        F.struct(F.lit(c).alias("split"), F.col(f"_s{i}").alias("level")) for i, c in enumerate(splits)
    ])).alias("s")).select("_response", "s.*")
    per_level = pairs.groupBy("split", "level").agg(
        F.count("*").alias("size"), F.sum("_response").alias("responders"))
    per_split = split_gini_from_groups(per_level, "size", "responders", "split")
    return per_split.join(per_level.groupBy("split").agg(F.count("*").alias("groups")), "split")


def targeting_profit(df: DataFrame, actual: str, predicted: str, profit_if_response,
                     profit_if_no_response) -> DataFrame:
    """Adds target, expected_profit and realized_profit per customer.

    A customer is contacted when the predicted probability lies above break-even; a missing
    prediction is never above. A missing actual counts as no response. Scores of the rows a model was
    fitted on give an in-sample profit.
    """
    p = number_column(df, predicted)
    vr, vn = F.lit(float(profit_if_response)), F.lit(float(profit_if_no_response))
    threshold = break_even_probability(vr, vn, "error")
    target = F.coalesce(p > threshold, F.lit(False))
    answered = F.coalesce(binary_column(df, actual) == 1, F.lit(False))
    return df.withColumns({
        "target": target,
        "expected_profit": p * vr + (1 - p) * vn,
        "realized_profit": F.when(target, F.when(answered, vr).otherwise(vn)).otherwise(F.lit(0.0)),
    })


def targeting_summary(df: DataFrame, actual: str, profit_if_response, profit_if_no_response) -> DataFrame:
    """One row: threshold, customers and responses reached, in-sample profit, from ``targeting_profit``."""
    vr, vn = F.lit(float(profit_if_response)), F.lit(float(profit_if_no_response))
    reached = F.when(F.col("target"), no_nan(binary_column(df, actual)))
    return df.agg(
        F.count_if("target").cast("double").alias("customers_targeted"),
        F.coalesce(F.sum(reached), F.lit(0.0)).alias("responses_targeted"),
        F.coalesce(F.sum("realized_profit"), F.lit(0.0)).alias("realized_profit"),
    ).withColumn("threshold", break_even_probability(vr, vn, "error"))
