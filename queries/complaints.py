"""Complaint histories from the event log; errors stand for complaints."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronage.functions.dates import elapsed_days, elapsed_units, moment
from patronage.functions.parse import classify_event
from patronage.operators.complaints import complaint_summary, recovery_value
from queries import query, rounded, table
from queries.customer_base import NBD
from patronage.functions.bgnbd import probability_active

EVENT_SQL = """
event AS (SELECT user_id, ts, CASE WHEN event_type = 'error' THEN 'Complaint ' ELSE event_type END AS kind FROM events),
mark AS (SELECT *, coalesce(regexp_matches(lower(trim(kind)), 'purchase|order'), false) AS buy,
                coalesce(contains(lower(kind), 'complaint'), false) AS moan FROM event)
"""

SUMMARY_SQL = f"""
{EVENT_SQL},
first AS (SELECT user_id, min(ts) FILTER (WHERE buy) AS first_buy, max(ts) AS last_event,
                 count(*) FILTER (WHERE buy) AS buys FROM mark GROUP BY user_id),
days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM mark WHERE buy),
moans AS (SELECT m.user_id, count(d.day) AS same, count(*) - count(d.day) AS other
          FROM mark m LEFT JOIN days d ON m.user_id = d.user_id AND CAST(m.ts AS DATE) = d.day WHERE moan GROUP BY 1),
final AS (SELECT f.user_id, max(CASE WHEN moan THEN 1 ELSE 0 END) AS flag
          FROM first f JOIN mark m ON f.user_id = m.user_id AND m.ts = f.last_event GROUP BY 1),
ends AS (SELECT max(ts) AS last_ts FROM events),
summary AS (
  SELECT f.user_id, CAST(buys - 1 AS BIGINT) AS xp_repeat_purchases,
    CAST(coalesce(same, 0) AS BIGINT) AS xc_given_p_same_day_complaints,
    CAST(coalesce(other, 0) AS BIGINT) AS xc_other_complaints,
    floor((epoch_us(last_event) - epoch_us(first_buy)) / 86400000000.0) / 7.0 AS tx_last_event,
    CAST(flag AS INTEGER) AS zc_last_event_involves_complaint,
    floor((epoch_us(last_ts) - epoch_us(first_buy)) / 86400000000.0) / 7.0 AS T_observation_length
  FROM first f LEFT JOIN moans USING (user_id) JOIN final USING (user_id), ends WHERE buys > 0)
"""


def log(spark, folder):
    kind = F.when(F.col("event_type") == "error", "Complaint ").otherwise(F.col("event_type"))
    return table(spark, folder, "events").withColumn("kind", kind)


@query(f"""
WITH {SUMMARY_SQL}
SELECT * REPLACE (round(tx_last_event, 6) AS tx_last_event, round(T_observation_length, 6) AS T_observation_length)
FROM summary""")
def complaint_summaries(spark, folder):
    return rounded(complaint_summary(log(spark, folder), "user_id", "ts", "kind"))


@query(f"""
WITH {EVENT_SQL}
SELECT event_id, buy AS purchase, moan AS complaint,
       CAST(floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(events.ts)) / 86400000000.0) AS INTEGER)
         AS days_left,
       round(floor((epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(events.ts)) / 86400000000.0) / 30.4375, 6)
         AS months_left
FROM events JOIN (SELECT DISTINCT kind, buy, moan FROM mark) k
  ON k.kind = CASE WHEN event_type = 'error' THEN 'Complaint ' ELSE event_type END""")
def classified_events(spark, folder):
    """Event marks, and elapsed time that runs below zero for the later events."""
    until = moment("2024-01-20 12:00:00")
    return rounded(log(spark, folder).select(
        "event_id", classify_event(F.col("kind")).alias("k"), elapsed_days(until, F.col("ts")).alias("days_left"),
        elapsed_units(until, F.col("ts"), "months").alias("months_left")).select(
        "event_id", "k.*", "days_left", "months_left"))


@query(f"""
WITH {SUMMARY_SQL},
value AS (SELECT user_id, 10.0 * (xp_repeat_purchases + 1) AS v,
            1 / (1 + CASE WHEN xp_repeat_purchases > 0 THEN 0.793 / (2.426 + xp_repeat_purchases - 1)
              * power((4.414 + T_observation_length) / (4.414 + greatest(tx_last_event, 0)), 0.243 + xp_repeat_purchases)
              ELSE 0 END) AS p
          FROM summary WHERE xc_given_p_same_day_complaints + xc_other_complaints > 0)
SELECT user_id, round(v * p, 6) AS clv_if_recovered, round(v * p * 0.6, 6) AS clv_if_unrecovered,
       round(v * p - v * p * 0.6, 6) AS maximum_financially_justified_recovery_cost,
       25.0::DOUBLE AS entered_recovery_cost, round(v * p - v * p * 0.6 - 25, 6) AS net_value_of_recovery
FROM value""")
def recovery_values(spark, folder):
    """What winning back each complaining customer is worth; staying on is the BG/NBD chance of activity."""
    summary = complaint_summary(log(spark, folder), "user_id", "ts", "kind")
    complainers = summary.where("xc_given_p_same_day_complaints + xc_other_complaints > 0").select(
        "user_id", (10.0 * (F.col("xp_repeat_purchases") + 1)).alias("future"),
        probability_active("xp_repeat_purchases", F.greatest("tx_last_event", F.lit(0.0)), "T_observation_length",
                           **NBD).alias("stay"))
    valued = recovery_value(complainers, "future", "stay", F.col("stay") * 0.6, 25.0)
    return rounded(valued.drop("future", "stay"))
