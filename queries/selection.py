"""RFM, lift, targeting and response models."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions.value import break_even_probability, gini_impurity
from patronage.operators.medians import exact_medians
from patronage.operators.ranking import lift_table, quantile_score, rfm_scores
from patronage.operators.summaries import drop_incomplete, rfm_from_transactions
from patronage.operators.targeting import (
    segment_response,
    targeting_profit,
    targeting_summary,
    weighted_split_gini,
)
from patronage.plans import analyses, holdout
from patronage.plans import response_models as models
from queries import query, rounded, table
from queries.shared import RESPONSE_SQL, response_table

RFM_SQL = """
ends AS (SELECT min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders),
rfm AS (
  SELECT o_custkey, max(o_orderdate) AS last_purchase, count(*) AS purchase_count,
         sum(o_totalprice) / count(*) AS monetary_average, sum(o_totalprice) AS monetary_total,
         CAST(floor((epoch_us(any_value(last_day)) - epoch_us(max(o_orderdate))) / 86400000000.0) AS INTEGER)
           AS recency_days,
         count(*) / greatest(floor((epoch_us(any_value(last_day)) - epoch_us(any_value(first_day)))
           / 86400000000.0) / 30.4375, 1 / 30.4375) AS frequency_per_month
  FROM orders, ends GROUP BY o_custkey)
"""


def score_sql(source: str, column: str, value: str, keys: str = "", best: str = "DESC", groups: int = 5,
              tie: str = "o_custkey") -> str:
    """A quantile score as its own pair of window subqueries."""
    over = f"PARTITION BY {keys}" if keys else ""
    return f"""
    SELECT * EXCLUDE (rk, n, d),
           CAST(CASE WHEN {value} IS NULL THEN NULL WHEN least({groups}, n, d) <= 1 THEN 1
                ELSE greatest(1, ((rk - 1) * least({groups}, n, d) + n - 2) // greatest(n - 1, 1)) END AS INTEGER)
             AS {column}
    FROM (SELECT *, row_number() OVER ({over} ORDER BY {value} {best} NULLS LAST, {tie}) AS rk,
                 count({value}) OVER ({over}) AS n, count(DISTINCT {value}) OVER ({over}) AS d FROM {source})"""


def _rfm(spark, folder):
    return rfm_from_transactions(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice")


@query(f"""
WITH {RFM_SQL}
SELECT o_custkey, last_purchase, purchase_count, round(monetary_average, 6) AS monetary_average,
       round(monetary_total, 6) AS monetary_total, recency_days, round(frequency_per_month, 6) AS frequency_per_month
FROM rfm""")
def rfm_inputs(spark, folder):
    return rounded(_rfm(spark, folder))


@query(f"""
WITH {RFM_SQL},
r AS ({score_sql("rfm", "R_score", "recency_days", best="ASC")}),
f AS ({score_sql("r", "F_score", "frequency_per_month", "R_score")}),
m AS ({score_sql("f", "M_score", "monetary_average", "R_score, F_score")})
SELECT o_custkey, R_score, F_score, M_score, R_score || '-' || F_score || '-' || M_score AS RFM_segment,
       R_score + F_score + M_score AS RFM_total FROM m""")
def rfm_scores_nested(spark, folder):
    scored = rfm_scores(_rfm(spark, folder), "recency_days", "frequency_per_month", "monetary_average", "o_custkey")
    return scored.select("o_custkey", "R_score", "F_score", "M_score", "RFM_segment", "RFM_total")


@query(f"""
WITH {RESPONSE_SQL},
r AS ({score_sql("response_table", "R_score", "recency_days", best="ASC", tie="c_custkey")}),
f AS ({score_sql("r", "F_score", "purchases", tie="c_custkey")}),
m AS ({score_sql("f", "M_score", "average_amount", tie="c_custkey")})
SELECT c_custkey, R_score::DOUBLE AS R_score, F_score::DOUBLE AS F_score, M_score::DOUBLE AS M_score,
       R_score || '-' || F_score || '-' || M_score AS RFM_segment, (R_score + F_score + M_score)::DOUBLE AS RFM_total
FROM m""")
def rfm_scores_independent(spark, folder):
    """Customers without an earlier order have no recency: no segment, no total."""
    scored = rfm_scores(response_table(spark, folder), "recency_days", "purchases", "average_amount", "c_custkey",
                        nested=False)
    scores = ("R_score", "F_score", "M_score", "RFM_total")
    # As doubles, because whole numbers with gaps have no common type outside Spark.
    return scored.select("c_custkey", "RFM_segment", *[F.col(c).cast("double").alias(c) for c in scores])


@query(f"""
WITH scored AS ({score_sql("customer", "score", "c_acctbal", "c_nationkey", groups=10, tie="c_custkey")})
SELECT c_custkey, c_nationkey, score FROM scored""")
def quantile_score_by_nation(spark, folder):
    return quantile_score(table(spark, folder, "customer"), "c_acctbal", "c_custkey", True, 10, "score",
                          "c_nationkey").select("c_custkey", "c_nationkey", "score")


@query(f"""
WITH {RESPONSE_SQL},
r AS ({score_sql("response_table", "R_score", "recency_days", best="ASC", tie="c_custkey")}),
f AS ({score_sql("r", "F_score", "purchases", "R_score", tie="c_custkey")}),
m AS ({score_sql("f", "M_score", "average_amount", "R_score, F_score", tie="c_custkey")})
SELECT R_score || '-' || F_score || '-' || M_score AS RFM_segment, count(*) AS customers,
       round(avg(response), 6) AS response_rate, CAST(sum(response) AS DOUBLE) AS responses
FROM m WHERE R_score IS NOT NULL AND F_score IS NOT NULL AND M_score IS NOT NULL GROUP BY 1""")
def segment_response_rates(spark, folder):
    scored = rfm_scores(response_table(spark, folder), "recency_days", "purchases", "average_amount", "c_custkey")
    return rounded(segment_response(scored, "RFM_segment", "response"))


def _split_sql(column: str) -> str:
    return f"""SELECT '{column}' AS split, round(sum(n / total * 2 * (k / n) * (1 - k / n)), 9) AS weighted_gini,
       count(*) AS groups
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(response) AS DOUBLE) AS k,
               CAST(sum(count(*)) OVER () AS DOUBLE) AS total
        FROM response_table GROUP BY {column})"""


@query(f"""
WITH {RESPONSE_SQL}
{_split_sql("c_mktsegment")} UNION ALL {_split_sql("c_nationkey")} UNION ALL {_split_sql("purchases")}
UNION ALL {_split_sql("recency_days")}""")
def split_gini(spark, folder):
    return rounded(weighted_split_gini(response_table(spark, folder),
                                       ["c_mktsegment", "c_nationkey", "purchases", "recency_days"], "response"), 9)


@query(f"""
WITH {RESPONSE_SQL},
g AS (SELECT c_nationkey, avg(response) AS rate, avg(average_amount) / 1000 AS gain, -avg(c_acctbal) / 500 AS loss
      FROM response_table GROUP BY c_nationkey)
SELECT c_nationkey, round(2 * rate * (1 - rate), 9) AS gini,
       CASE WHEN gain > loss THEN round(least(1, greatest(0, -loss / (gain - loss))), 9) END AS break_even
FROM g""")
def gini_and_break_even(spark, folder):
    g = response_table(spark, folder).groupBy("c_nationkey").agg(
        F.avg("response").alias("rate"), (F.avg("average_amount") / 1000).alias("gain"),
        (-F.avg("c_acctbal") / 500).alias("loss"))
    return rounded(g.select("c_nationkey", gini_impurity("rate").alias("gini"),
                            break_even_probability("gain", "loss").alias("break_even")), 9)


# A given score to rank by, with many equal values.
GUESS_SQL = "CASE WHEN purchases > 0 THEN round(1 / (1 + exp(3 - purchases / 3)), 9) END"


def _guessed(spark, folder):
    guess = F.round(1 / (1 + F.exp(3 - F.col("purchases") / 3)), 9)
    return response_table(spark, folder).withColumn("predicted", F.when(F.col("purchases") > 0, guess))


@query(f"""
WITH {RESPONSE_SQL},
s AS (SELECT *, {GUESS_SQL} AS predicted FROM response_table),
d AS (SELECT response, greatest(1, ((row_number() OVER (ORDER BY predicted DESC, c_custkey) - 1) * 10
             + count(*) OVER () - 2) // (count(*) OVER () - 1)) AS decile
      FROM s WHERE predicted IS NOT NULL),
g AS (SELECT CAST(decile AS INTEGER) AS decile, count(*) AS customers, CAST(sum(response) AS DOUBLE) AS responses,
             avg(response) AS response_rate FROM d GROUP BY decile),
b AS (SELECT avg(response) AS base FROM d)
SELECT decile, customers, responses, round(response_rate, 6) AS response_rate, round(response_rate / base, 6) AS lift,
       round(sum(response_rate / base) OVER w, 6) AS summed_decile_lift,
       round(sum(responses) OVER w / sum(customers) OVER w, 6) AS cumulative_response_rate,
       round(sum(responses) OVER w / sum(customers) OVER w / base, 6) AS standard_cumulative_lift
FROM g, b WINDOW w AS (ORDER BY decile)""")
def lift_by_decile(spark, folder):
    return rounded(lift_table(_guessed(spark, folder), "response", "predicted", "c_custkey"))


TARGET_SQL = f"""
s AS (SELECT *, {GUESS_SQL} AS predicted FROM response_table),
t AS (SELECT *, coalesce(predicted > 2 / 8.0, false) AS target FROM s)
"""


@query(f"""
WITH {RESPONSE_SQL}, {TARGET_SQL}
SELECT c_custkey, target, round(predicted * 6 + (1 - predicted) * -2, 6) AS expected_profit,
       CASE WHEN NOT target THEN 0.0 WHEN response = 1 THEN 6.0 ELSE -2.0 END::DOUBLE AS realized_profit FROM t""")
def targeting_per_customer(spark, folder):
    scored = targeting_profit(_guessed(spark, folder), "response", "predicted", 6.0, -2.0)
    return rounded(scored.select("c_custkey", "target", "expected_profit", "realized_profit"))


@query(f"""
WITH {RESPONSE_SQL}, {TARGET_SQL}
SELECT CAST(count(*) FILTER (WHERE target) AS DOUBLE) AS customers_targeted,
       CAST(sum(response) FILTER (WHERE target) AS DOUBLE) AS responses_targeted,
       CAST(sum(CASE WHEN NOT target THEN 0 WHEN response = 1 THEN 6 ELSE -2 END) AS DOUBLE) AS realized_profit,
       0.25::DOUBLE AS threshold FROM t""")
def targeting_totals(spark, folder):
    scored = targeting_profit(_guessed(spark, folder), "response", "predicted", 6.0, -2.0)
    return targeting_summary(scored, "response", 6.0, -2.0)


@query(f"""
WITH {RESPONSE_SQL}
SELECT c_custkey, recency_days, round(average_amount, 6) AS average_amount FROM response_table
WHERE recency_days IS NOT NULL AND average_amount IS NOT NULL""")
def complete_rows(spark, folder):
    kept = drop_incomplete(response_table(spark, folder), "recency_days", "average_amount")
    return rounded(kept.select("c_custkey", "recency_days", "average_amount"))


PREDICTORS = ["recency_days", "purchases", "average_amount", "c_acctbal", "c_mktsegment"]


@query(f"""
WITH {RESPONSE_SQL},
g AS (SELECT c_mktsegment AS level, count(*) AS n, avg(response) AS p FROM response_table GROUP BY 1),
f AS (SELECT * FROM g ORDER BY level LIMIT 1),
c AS (SELECT 'const' AS term, ln(p / (1 - p)) AS coefficient, sqrt(1 / (n * p * (1 - p))) AS std_error FROM f
      UNION ALL
      SELECT 'c_mktsegment_' || g.level, ln(g.p / (1 - g.p)) - ln(f.p / (1 - f.p)),
             sqrt(1 / (g.n * g.p * (1 - g.p)) + 1 / (f.n * f.p * (1 - f.p))) FROM g, f WHERE g.level <> f.level)
SELECT term, round(coefficient, 5) AS coefficient, round(std_error, 5) AS std_error,
       round(power(coefficient / std_error, 2), 3) AS wald, round(exp(coefficient), 5) AS odds_ratio FROM c""")
def logistic_by_segment(spark, folder):
    """With one text predictor the likelihood has a closed solution: the segments' response rates."""
    table_ = models.fit_logistic(response_table(spark, folder), "response", ["c_mktsegment"]).coefficients
    return table_.select("term", F.round("wald", 3).alias("wald"), *[
        F.round(c, 5).alias(c) for c in ("coefficient", "std_error", "odds_ratio")])


@query(f"""
WITH {RESPONSE_SQL}
SELECT c_custkey, round(avg(response) OVER (PARTITION BY c_mktsegment), 6) AS predicted_probability
FROM response_table""")
def logistic_scores_by_segment(spark, folder):
    scored = models.fit_logistic(response_table(spark, folder), "response", ["c_mktsegment"]).scored
    return rounded(scored.select("c_custkey", "predicted_probability"))


@query(f"""
WITH {RESPONSE_SQL},
v AS (SELECT purchases, count(*) AS n, sum(response) AS k FROM response_table GROUP BY purchases),
c AS (SELECT purchases AS cut, sum(n) OVER (ORDER BY purchases) AS n1, sum(k) OVER (ORDER BY purchases) AS k1,
             sum(n) OVER () AS n, sum(k) OVER () AS k FROM v),
best AS (SELECT *, k1 * (1 - k1 / n1) + (k - k1) * (1 - (k - k1) / (n - n1)) AS impurity
         FROM c WHERE n1 >= 10 AND n - n1 >= 10 ORDER BY impurity, cut LIMIT 1)
SELECT c_custkey, round(CASE WHEN purchases <= cut THEN k1 / n1 ELSE (k - k1) / (n - n1) END, 6)
         AS predicted_probability FROM response_table, best""")
def tree_with_one_split(spark, folder):
    """The best of all splits by earlier purchases, found in SQL by trying each."""
    fitted = models.fit_decision_tree(response_table(spark, folder), "response", ["purchases"], 1, 10)
    return rounded(fitted.scored.select("c_custkey", "predicted_probability"))


def _cuts_sql(name: str, rows: str) -> str:
    """CTEs that try every cut of every node of ``rows`` and keep the best of each."""
    return f"""
{name}_v AS (SELECT node, pos, v, lev, CAST(count(*) AS DOUBLE) AS n, CAST(sum(response) AS DOUBLE) AS k FROM (
    SELECT node, 0 AS pos, CAST(purchases AS DOUBLE) AS v, '' AS lev, response FROM {rows}
    UNION ALL SELECT node, 1, c_acctbal, '', response FROM {rows}
    UNION ALL SELECT node, 2, 0.0, c_mktsegment, response FROM {rows}) GROUP BY ALL),
{name}_t AS (SELECT node, CAST(count(*) AS DOUBLE) AS nn, CAST(sum(response) AS DOUBLE) AS kk FROM {rows} GROUP BY node),
{name}_c AS (SELECT *, CASE WHEN pos < 2 THEN sum(n) OVER w ELSE nn - n END AS n1, CASE WHEN pos < 2 THEN sum(k) OVER w ELSE kk - k END AS k1,
                    CASE WHEN pos < 2 THEN lead(v) OVER w ELSE 1 END AS nx
             FROM {name}_v JOIN {name}_t USING (node) WINDOW w AS (PARTITION BY node, pos ORDER BY v, lev)),
{name} AS (SELECT *, k1 * k1 / n1 + (kk - k1) * (kk - k1) / (nn - n1) AS score FROM {name}_c
           WHERE n1 >= 10 AND nn - n1 >= 10 AND nx IS NOT NULL AND score - kk * kk / nn > 1e-12 * kk * kk / nn
           QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, pos, v, lev) = 1),
{name}_r AS (SELECT r.* EXCLUDE (node), CASE WHEN c.node IS NULL THEN -r.node - 1
                      WHEN CASE pos WHEN 0 THEN purchases <= (v + nx) / 2 WHEN 1 THEN c_acctbal <= (v + nx) / 2 ELSE c_mktsegment <> lev END
                      THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node FROM {rows} r LEFT JOIN {name} c ON r.node = c.node)"""


@query(f"""
WITH {RESPONSE_SQL},
start AS (SELECT *, 0 AS node FROM response_table),
{_cuts_sql("one", "start")}, {_cuts_sql("two", "one_r")}
SELECT c_custkey, round(avg(response) OVER (PARTITION BY node), 6) AS predicted_probability FROM two_r""")
def tree_with_two_levels(spark, folder):
    """Numbers and a text; the SQL tries every cut of the table, then every cut of both halves."""
    fitted = models.fit_decision_tree(response_table(spark, folder), "response", ["purchases", "c_acctbal", "c_mktsegment"], 2, 10)
    return rounded(fitted.scored.select("c_custkey", "predicted_probability"))


@query(f"""
WITH {RESPONSE_SQL},
start AS (SELECT *, 0 AS node FROM response_table),
{_cuts_sql("one", "start")}, {_cuts_sql("two", "one_r")},
cut AS (SELECT pos, lev, score - kk * kk / nn AS gain FROM one UNION ALL SELECT pos, lev, score - kk * kk / nn FROM two),
share AS (SELECT CASE pos WHEN 0 THEN 'purchases' WHEN 1 THEN 'c_acctbal' ELSE 'c_mktsegment_' || lev END AS feature,
                 sum(gain) / (SELECT sum(gain) FROM cut) AS importance FROM cut GROUP BY ALL),
term AS (SELECT 'purchases' AS feature UNION ALL SELECT 'c_acctbal' UNION ALL SELECT DISTINCT 'c_mktsegment_' || c_mktsegment FROM response_table)
SELECT feature, round(coalesce(importance, 0), 6) AS importance FROM term LEFT JOIN share USING (feature)""")
def tree_importance_of_two_levels(spark, folder):
    return rounded(models.fit_decision_tree(
        response_table(spark, folder), "response", ["purchases", "c_acctbal", "c_mktsegment"], 2, 10).feature_importance)


# Four folds by the MD5 of the key; a segment's rate in the other three folds is the model's score.
FOLD_SQL = """
fold AS (SELECT *, CAST('0x' || substr(md5(':' || c_custkey), 1, 8) AS BIGINT) % 4 AS fold FROM response_table),
cell AS (SELECT c_mktsegment, fold, count(*) AS n, sum(response) AS k FROM fold GROUP BY ALL),
rest AS (SELECT c_mktsegment, fold, (sum(k) OVER w - k) / (sum(n) OVER w - n) AS p FROM cell WINDOW w AS (PARTITION BY c_mktsegment)),
s AS (SELECT c_custkey, response, CAST(fold AS INTEGER) AS fold, round(p, 6) AS predicted FROM fold JOIN rest USING (c_mktsegment, fold))
"""


def _held_out(spark, folder):
    return rounded(holdout.out_of_fold(response_table(spark, folder), "c_custkey", "response", ["c_mktsegment"], folds=4))


@query(f"WITH {RESPONSE_SQL}, {FOLD_SQL} SELECT c_custkey, fold, predicted AS predicted_probability FROM s")
def held_out_scores_by_segment(spark, folder):
    return _held_out(spark, folder).select("c_custkey", "fold", "predicted_probability")


@query(f"""
WITH {RESPONSE_SQL}, {FOLD_SQL},
d AS (SELECT response, greatest(1, ((row_number() OVER (ORDER BY predicted DESC, c_custkey) - 1) * 10
             + count(*) OVER () - 2) // (count(*) OVER () - 1)) AS decile FROM s),
g AS (SELECT CAST(decile AS INTEGER) AS decile, count(*) AS customers, CAST(sum(response) AS DOUBLE) AS responses,
             avg(response) AS response_rate FROM d GROUP BY decile),
b AS (SELECT avg(response) AS base FROM d)
SELECT decile, customers, responses, round(response_rate, 6) AS response_rate, round(response_rate / base, 6) AS lift FROM g, b""")
def held_out_lift_by_segment(spark, folder):
    return rounded(lift_table(_held_out(spark, folder), "response", "predicted_probability", "c_custkey").select(
        "decile", "customers", "responses", "response_rate", "lift"))


@query(f"""
WITH {RESPONSE_SQL}, {FOLD_SQL}
SELECT CAST(count(*) FILTER (WHERE predicted > 0.6) AS DOUBLE) AS customers_targeted,
       CAST(coalesce(sum(response) FILTER (WHERE predicted > 0.6), 0) AS DOUBLE) AS responses_targeted,
       CAST(sum(CASE WHEN predicted <= 0.6 THEN 0 WHEN response = 1 THEN 4 ELSE -6 END) AS DOUBLE) AS realized_profit,
       0.6::DOUBLE AS threshold FROM s""")
def held_out_profit_by_segment(spark, folder):
    scored = targeting_profit(_held_out(spark, folder), "response", "predicted_probability", 4.0, -6.0)
    return rounded(targeting_summary(scored, "response", 4.0, -6.0))


@query()
def held_out_tree_lift(spark, folder):
    return holdout.held_out(response_table(spark, folder), "c_custkey", "response", PREDICTORS, 25.0, -2.0, "tree", folds=3).lift


@query()
def logistic_coefficients(spark, folder):
    return models.fit_logistic(response_table(spark, folder), "response", PREDICTORS).coefficients


@query(f"""
WITH {RESPONSE_SQL},
filled AS (SELECT response, c_mktsegment, purchases, c_acctbal, coalesce(recency_days, (SELECT median(recency_days) FROM response_table)) AS recency_days,
                  coalesce(average_amount, (SELECT median(average_amount) FROM response_table)) AS average_amount FROM response_table),
term AS (UNPIVOT (SELECT response AS y, 1.0::DOUBLE AS const, CAST(recency_days AS DOUBLE) AS recency_days, CAST(purchases AS DOUBLE) AS purchases,
                         average_amount, c_acctbal FROM filled)
         ON const, recency_days, purchases, average_amount, c_acctbal INTO NAME term VALUE x)
SELECT term, round(sum(y * x), 2) AS observed, round(sum(y * x), 2) AS expected FROM term GROUP BY term
UNION ALL SELECT 'c_mktsegment_' || c_mktsegment, round(sum(response), 2)::DOUBLE, round(sum(response), 2)::DOUBLE FROM filled
WHERE c_mktsegment > (SELECT min(c_mktsegment) FROM filled) GROUP BY c_mktsegment""")
def logistic_score_equations(spark, folder):
    """At the maximum of the likelihood each term's sum over predictions is its sum over responses, which SQL knows."""
    scored = models.fit_logistic(response_table(spark, folder), "response", PREDICTORS).scored
    medians = exact_medians(scored, ["recency_days", "average_amount"])
    segments = [r[0] for r in scored.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()][1:]
    numbers = {"const": F.lit(1.0), "purchases": F.col("purchases"), "c_acctbal": F.col("c_acctbal"),
               **{c: F.coalesce(F.col(c), F.lit(medians[c])) for c in medians}}
    terms = numbers | {f"c_mktsegment_{s}": (F.col("c_mktsegment") == s).cast("int") for s in segments}
    long = scored.select("response", "predicted_probability", F.explode(F.array(*[
        F.struct(F.lit(t).alias("term"), x.cast("double").alias("x")) for t, x in terms.items()])).alias("t"))
    return rounded(long.groupBy("t.term").agg(F.sum(F.col("response") * F.col("t.x")).alias("observed"),
                                              F.sum(F.col("predicted_probability") * F.col("t.x")).alias("expected")), 2)


@query()
def logistic_scores(spark, folder):
    scored = models.fit_logistic(response_table(spark, folder), "response", PREDICTORS).scored
    return rounded(scored.select("c_custkey", "predicted_probability"))


@query()
def decision_tree_scores(spark, folder):
    fitted = models.fit_decision_tree(response_table(spark, folder), "response", PREDICTORS)
    return rounded(fitted.scored.select("c_custkey", "predicted_probability"))


@query()
def decision_tree_importance(spark, folder):
    return rounded(models.fit_decision_tree(response_table(spark, folder), "response", PREDICTORS).feature_importance)


@query()
def targeting_lift(spark, folder):
    return analyses.targeting_analysis(response_table(spark, folder), "c_custkey", "response", PREDICTORS,
                                       25.0, -2.0).lift


@query(f"""
WITH {RFM_SQL},
r AS ({score_sql("rfm", "R_score", "recency_days", best="ASC")}),
f AS ({score_sql("r", "F_score", "frequency_per_month", "R_score")}),
m AS ({score_sql("f", "M_score", "monetary_average", "R_score, F_score")})
SELECT R_score || '-' || F_score || '-' || M_score AS RFM_segment, count(*) AS customers FROM m GROUP BY 1""")
def rfm_segments_from_log(spark, folder):
    return analyses.rfm_from_log(table(spark, folder, "orders"), "o_custkey", "o_orderdate", "o_totalprice").segments
