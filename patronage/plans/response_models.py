"""Response models: logistic regression on Spark ML and a decision tree, with scores for every row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.functions.parse import binary_column, number_column
from patronage.operators.medians import exact_medians
from patronage.plans import absorbed, trees
from patronage.scratch import stored

# Spark's weighted least squares solves the normal equations on the driver: terms × terms numbers.
MOST_TERMS = 4096
# Fixed value: most iterations of the logistic fit.
MOST_ITERATIONS = 500
PREDICTED = "predicted_probability"
LABEL, FEATURES = "_label", "_features"


@dataclass(frozen=True)
class LogisticModel:
    """``scored``: the input with predicted_probability. ``coefficients``: a row per term."""

    scored: DataFrame
    coefficients: DataFrame
    log_likelihood: float
    null_log_likelihood: float


@dataclass(frozen=True)
class TreeModel:
    """``scored``: the input with predicted_probability. ``rules`` as text, ``feature_importance`` as rows."""

    scored: DataFrame
    rules: str
    feature_importance: DataFrame


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.NumericType, T.BooleanType))


def _model_rows(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """The input with its 0/1 outcome as ``_label``, written once, and the outcome checked.

    Medians, levels and every iteration of a fit read this table, a few columns at a time, instead of
    whatever the input is computed from.
    """
    require_columns(df, outcome, *predictors)
    if not predictors:
        raise InputProblem("No predictor was given.")
    if outcome in predictors:
        raise InputProblem("The outcome is also a predictor.", "Remove it from the predictors.")
    rows = stored(df.withColumn(LABEL, binary_column(df, outcome)), "model-rows")
    answer = F.col(LABEL)
    values = rows.agg(F.count_if(answer == 0).alias("no"), F.count_if(answer == 1).alias("yes"),
                      F.count_if(answer.isNotNull() & ~answer.isin(0.0, 1.0)).alias("other")).first()
    if values["other"]:
        raise InputProblem(f"'{outcome}' holds values other than 0 and 1.")
    if not values["no"] or not values["yes"]:
        raise InputProblem(f"'{outcome}' must contain both 0 and 1.")
    return rows


def _levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Sorted levels with their row counts per text column; each level will be a model term, so their
    number is bounded by the number of terms a model may have."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), field(c).cast("string").alias("level")) for c in columns
    ])).alias("p")).select("p.*").where(F.col("level").isNotNull())
    found = long.groupBy("column", "level").count().limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise InputProblem(f"The text predictors have more than {MOST_TERMS:,} levels.",
                           "Leave out columns that identify rows.")
    out: dict[str, list[tuple[str, int]]] = {c: [] for c in columns}
    for r in sorted(found, key=lambda r: r["level"]):
        out[r["column"]].append((r["level"], r["count"]))
    return out


def _filled(df: DataFrame, column: str, fill: float | None) -> Column:
    return F.coalesce(number_column(df, column), F.lit(0.0 if fill is None else float(fill)))


def _design(rows: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """The rows with the vector of model terms."""
    if len(terms) > MOST_TERMS:
        raise InputProblem(f"{len(terms):,} model terms; at most {MOST_TERMS:,} are supported.")
    names = [f"_t{i}" for i in range(len(terms))]
    wide = rows.withColumns(dict(zip(names, terms.values())))
    return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(wide).drop(*names)


def _scored(model, rows: DataFrame, everyone: bool) -> DataFrame:
    known = F.lit(True) if everyone else F.col(LABEL).isNotNull()
    return model.transform(rows).withColumn(PREDICTED, F.when(known, F.col(PREDICTED))).drop(LABEL, FEATURES)


def _logistic_terms(df: DataFrame, predictors: Sequence[str]) -> dict[str, Column]:
    """Numbers first, then 0/1 columns for all but the first level of each text predictor.

    A missing number takes the median of all rows, with or without an outcome; a missing text is 0 in
    every column.
    """
    numbers = [c for c in predictors if _is_number(df, c)]
    medians = exact_medians(df, numbers)
    terms = {c: _filled(df, c, medians[c]) for c in numbers}
    levels = _levels(df, [c for c in predictors if c not in numbers])
    for c in predictors:
        for level, _ in levels.get(c, [])[1:]:
            terms[f"{c}_{level}"] = F.coalesce((field(c).cast("string") == level).cast("double"), F.lit(0.0))
    return terms


def _fit_absorbed(rows: DataFrame, predictors: Sequence[str], widest: str, first: str, everyone: bool) -> LogisticModel:
    """The fit whose text predictor ``widest`` has any number of levels, each of them a row; see ``absorbed``."""
    terms = _logistic_terms(rows, [c for c in predictors if c != widest])
    if len(terms) > MOST_TERMS:
        raise InputProblem(f"{len(terms):,} model terms beside '{widest}'; at most {MOST_TERMS:,} are supported.")
    level = F.coalesce(field(widest).cast("string"), F.lit(first))  # a missing text counts as the first level
    found = absorbed.fit(rows.where(F.col(LABEL).isNotNull()), LABEL, level, terms, first)
    spark = rows.sparkSession
    few = spark.createDataFrame([(i, n, float(v), float(e)) for i, (n, v, e) in enumerate(zip(
        ["const", *terms], [found.const, *found.slopes], [found.const_error, *found.errors]))],
        "position int, term string, coefficient double, std_error double")
    many = found.levels.where(F.col("level") != first).select(
        F.lit(len(terms) + 1).alias("position"), F.concat(F.lit(f"{widest}_"), F.col("level")).alias("term"),
        (F.col("alpha") - found.first_alpha).alias("coefficient"), "std_error")

    @F.pandas_udf("double")
    def chance(z: pd.Series) -> pd.Series:
        return z.abs().map(lambda v: math.erfc(v / math.sqrt(2)))

    ratio = F.col("coefficient") / F.col("std_error")
    coefficients = few.unionByName(many).orderBy("position", "term").select(
        "term", "coefficient", "std_error", F.pow(ratio, 2).alias("wald"), chance(ratio).alias("p_value"),
        F.exp("coefficient").alias("odds_ratio"))
    slopes = F.array(*[F.lit(float(v)) for v in found.slopes]).cast("array<double>")
    values = F.array(*[c.cast("double") for c in terms.values()]).cast("array<double>")
    effect = F.aggregate(F.zip_with(values, slopes, lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    # A level without any outcome counts as the first.
    own = found.levels.select(F.col("level").alias("_level"), (F.col("alpha") - found.first_alpha).alias("_effect"))
    joined = rows.withColumn("_own", level).join(own, F.col("_own") == F.col("_level"), "left")
    p = 1 / (1 + F.exp(-(F.lit(found.const) + F.coalesce("_effect", F.lit(0.0)) + effect)))
    scored = joined.withColumn(PREDICTED, F.when(F.lit(everyone) | F.col(LABEL).isNotNull(), p)).drop(LABEL, "_own", "_level", "_effect")
    counts = rows.agg(F.sum(LABEL).alias("k"), F.count(LABEL).alias("n")).first()
    k, n = counts["k"], counts["n"]
    null = k * math.log(k / n) + (n - k) * math.log(1 - k / n)
    return LogisticModel(scored, coefficients, found.log_likelihood, null)


def fit_logistic(df: DataFrame, outcome: str, predictors: Sequence[str], everyone: bool = False,
                 absorb: bool | None = None) -> LogisticModel:
    """Logistic regression of a 0/1 outcome, with Wald statistics and odds ratios.

    Rows without an outcome take no part in the fit and get no prediction, unless ``everyone`` is to be scored. Up to
    ``MOST_TERMS`` levels of the text predictors, Spark's least squares solve for all terms. Beyond, or with ``absorb``, the
    levels of the widest text predictor stay rows of a table; both ways find the same maximum.
    """
    rows = _model_rows(df, outcome, predictors)
    words = [c for c in predictors if not _is_number(rows, c)]
    if words and absorb is not False:
        known = rows.where(F.col(LABEL).isNotNull())
        wide = trees.text_levels(known, words, lambda c: field(c).cast("string")).groupBy("column").agg(
            F.count("*").alias("n"), F.min("level").alias("first")).orderBy(F.desc("n"), "column").collect()
        if wide and (absorb or sum(w["n"] for w in wide) > MOST_TERMS):
            return _fit_absorbed(rows, predictors, wide[0]["column"], wide[0]["first"], everyone)
    terms = _logistic_terms(rows, predictors)
    rows = _design(rows, terms)
    known = rows.where(F.col(LABEL).isNotNull())
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=LABEL, featuresCol=FEATURES, predictionCol=PREDICTED,
        maxIter=MOST_ITERATIONS, tol=1e-10).fit(known)
    summary = model.summary
    # Spark lists the intercept's statistics last; here it comes first.
    names = ["const", *terms]
    values = [model.intercept, *model.coefficients]
    errors = [summary.coefficientStandardErrors[-1], *summary.coefficientStandardErrors[:-1]]
    chances = [summary.pValues[-1], *summary.pValues[:-1]]
    table = df.sparkSession.createDataFrame(
        [(i, n, float(v), float(e), float(p)) for i, (n, v, e, p) in enumerate(zip(names, values, errors, chances))],
        "position int, term string, coefficient double, std_error double, p_value double")
    coefficients = table.orderBy("position").select(
        "term", "coefficient", "std_error", F.pow(F.col("coefficient") / F.col("std_error"), 2).alias("wald"),
        "p_value", F.exp("coefficient").alias("odds_ratio"))
    # For 0/1 rows the deviance is −2 ln L.
    return LogisticModel(_scored(model, rows, everyone), coefficients, -summary.deviance / 2, -summary.nullDeviance / 2)


def fit_decision_tree(df: DataFrame, outcome: str, predictors: Sequence[str], max_depth: int = 4,
                      min_samples_leaf: int = 50, everyone: bool = False) -> TreeModel:
    """A tree of Gini splits whose leaves give response probabilities.

    Thresholds lie midway between two neighbouring values of a node's rows, whatever their number; each level of a text
    predictor may be cut off. Of equally good cuts the first predictor's, smallest one is taken, numbers before texts. A missing
    number takes the median, a missing text the most frequent level (the first of equals). Rows without an outcome get no
    prediction, unless ``everyone`` is to be scored.
    """
    rows = _model_rows(df, outcome, predictors)
    known = rows.where(F.col(LABEL).isNotNull())
    numeric = [c for c in predictors if _is_number(df, c)]
    words = [c for c in predictors if c not in numeric]
    medians = exact_medians(known, numeric)
    numbers = {c: _filled(rows, c, medians[c]) for c in numeric}
    # One row per level; the most frequent of each column reaches the driver.
    levels = trees.text_levels(known, words, lambda c: field(c).cast("string")) if words else None
    usual = {r["column"]: r["level"] for r in levels.groupBy("column").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "level")).alias("u")).select("column", "u.level").collect()} if words else {}
    texts = {c: F.coalesce(field(c).cast("string"), F.lit(usual.get(c, ""))) for c in words}
    tree = trees.grow(rows, LABEL, numbers, texts, max_depth, min_samples_leaf)
    chance = F.when(F.lit(everyone) | F.col(LABEL).isNotNull(), trees.score(tree, numbers | texts))
    spark = df.sparkSession
    cut = spark.createDataFrame(list(trees.gains(tree).items()), "feature string, _share double")
    features = spark.createDataFrame([(c,) for c in numeric], "feature string")
    if words:
        features = features.unionByName(levels.select(F.concat_ws("_", "column", "level").alias("feature")))
    importance = features.join(F.broadcast(cut), "feature", "left").select(
        "feature", F.coalesce("_share", F.lit(0.0)).alias("importance")).orderBy(F.desc("importance"), "feature")
    return TreeModel(rows.withColumn(PREDICTED, chance).drop(LABEL), trees.rules(tree), importance)
