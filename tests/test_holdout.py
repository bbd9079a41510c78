"""Folds and scores by models that have not seen the customers."""

import pytest
from pyspark.sql import functions as F

from patronage.errors import InputProblem
from patronage.plans import analyses, holdout
from patronage.plans import response_models as models


@pytest.fixture(scope="module")
def customers(spark):
    """Response depends on the region; the noise column says nothing."""
    rows = spark.range(900).select("id", F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("region"),
                                   F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("noise"))
    return rows.withColumn("answer", F.when(F.col("id") >= 880, None).otherwise(
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10)) < 2 + 3 * (F.col("id") % 3)).cast("int")))


def test_folds_are_the_same_in_every_run(spark, customers):
    folds = customers.select("id", holdout.fold_of(F.col("id"), 4).alias("f"))
    assert folds.collect() == customers.repartition(7).select("id", holdout.fold_of(F.col("id"), 4).alias("f")).orderBy("id").collect()
    sizes = [r["count"] for r in folds.groupBy("f").count().collect()]
    assert len(sizes) == 4 and min(sizes) > 170
    other = customers.select("id", holdout.fold_of(F.col("id"), 4, "again").alias("f")).collect()
    assert other != folds.collect()
    with pytest.raises(InputProblem):
        holdout.fold_of(F.col("id"), 1)
    missing = spark.createDataFrame([(None,), (None,)], "id long").select(holdout.fold_of(F.col("id")).alias("f")).collect()
    assert missing[0] == missing[1] and missing[0].f is not None


def test_a_fold_is_scored_by_the_others(customers):
    found = holdout.out_of_fold(customers, "id", "answer", ["region"], folds=3).collect()
    assert len(found) == 900
    for fold in range(3):
        for region in ("r0", "r1", "r2"):
            seen = [r.answer for r in found if r.fold != fold and r.region == region and r.answer is not None]
            own = {round(r.predicted_probability, 8) for r in found if r.fold == fold and r.region == region}
            assert own == {round(sum(seen) / len(seen), 8)}


def test_held_out_lift_of_noise_is_lower(customers):
    """A deep tree on noise looks good on its own rows and not on others."""
    known = customers.where("answer IS NOT NULL")
    result = analyses.targeting_analysis(known, "id", "answer", ["noise"], 4.0, -5.0, "tree", folds=3,
                                         max_depth=5, min_samples_leaf=5)
    inside, outside = (x.orderBy("decile").first()["lift"] for x in (result.lift, result.held_out.lift))
    assert inside > 1.25 and outside < inside - 0.1
    assert result.held_out.summary.first()["realized_profit"] < result.summary.first()["realized_profit"]
    assert result.held_out.scores.count() == known.count()


def test_everyone_is_scored_if_asked(customers):
    for fit in (models.fit_logistic, models.fit_decision_tree):
        assert fit(customers, "answer", ["region"]).scored.where("predicted_probability IS NULL").count() == 20
        assert fit(customers, "answer", ["region"], everyone=True).scored.where("predicted_probability IS NULL").count() == 0
    with pytest.raises(InputProblem):
        holdout.out_of_fold(customers, "id", "answer", ["region"], "forest")
