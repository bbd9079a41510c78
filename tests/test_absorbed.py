"""Logistic fits whose widest text predictor is absorbed, against Spark's least squares and in closed form."""

import math

import pytest
from pyspark.sql import functions as F

from patronage.plans import response_models as models


@pytest.fixture(scope="module")
def customers(spark):
    def noise(seed):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_000)) / 10_000.0

    rows = spark.range(6_000).select(
        "id", (40 + 30 * noise(1)).alias("age"), (1000 * noise(2)).alias("spend"),
        F.concat(F.lit("shop"), (F.col("id") * 7 % 23).cast("string")).alias("shop"),
        F.when(F.col("id") % 50 == 0, None).otherwise(F.concat(F.lit("r"), (F.col("id") % 4).cast("string"))).alias("region"))
    chance = 1 / (1 + F.exp(-(F.col("age") / 30 - 2 + F.col("id") % 4 / 3.0 + F.col("id") * 7 % 23 / 20.0)))
    return rows.withColumn("answer", F.when(F.col("id") > 5_900, None).otherwise((noise(3) < chance).cast("int")))


def test_the_absorbed_fit_is_the_whole_fit(customers):
    for predictors in (["age", "spend", "shop", "region"], ["shop"], ["region", "age"]):
        one = models.fit_logistic(customers, "answer", predictors, absorb=False)
        two = models.fit_logistic(customers, "answer", predictors, absorb=True)
        a, b = ({r.term: r for r in m.coefficients.collect()} for m in (one, two))
        assert set(a) == set(b)
        for term in a:
            for column in ("coefficient", "std_error", "wald", "p_value", "odds_ratio"):
                assert b[term][column] == pytest.approx(a[term][column], rel=1e-5, abs=1e-7), (term, column)
        assert two.log_likelihood == pytest.approx(one.log_likelihood, rel=1e-9)
        assert two.null_log_likelihood == pytest.approx(one.null_log_likelihood, rel=1e-9)
        p, q = ({r.id: r.predicted_probability for r in m.scored.collect()} for m in (one, two))
        assert all((p[i] is None) == (q[i] is None) and (p[i] is None or abs(p[i] - q[i]) < 1e-6) for i in p)


def test_fifty_thousand_levels(spark):
    """Rates per level in closed form; a third of all rows lies in one level, and some levels always or never respond."""
    rows = spark.range(600_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50_000).cast("string"))).alias("shop"),
        (F.pmod(F.xxhash64("id"), F.lit(10)) < 3 + F.col("id") % 5).cast("int").alias("answer"))
    model = models.fit_logistic(rows, "answer", ["shop"])
    rates = {r.shop: (r.p, r.n) for r in rows.groupBy("shop").agg(F.avg("answer").alias("p"), F.count("*").alias("n")).collect()}
    assert len(rates) > 49_000
    found = {r.shop: r.p for r in model.scored.groupBy("shop").agg(F.first("predicted_probability").alias("p")).collect()}
    assert all(abs(found[s] - rates[s][0]) < 1e-4 for s in rates)
    terms = {r.term: r for r in model.coefficients.where("std_error < 10").collect()}
    p, n = rates["hot"]
    for shop in list(rates)[:200]:
        own, count = rates[shop]
        if 0 < own < 1 and shop != "hot":
            r = terms[f"shop_{shop}"]
            assert r.coefficient == pytest.approx(math.log(own / (1 - own)) - math.log(p / (1 - p)), abs=1e-6)
            assert r.std_error == pytest.approx(math.sqrt(1 / (count * own * (1 - own)) + 1 / (n * p * (1 - p))), rel=1e-5)
