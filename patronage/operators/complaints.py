"""Complaint histories per customer and the value of winning a complainer back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import as_column, field, guarded, require_distinct_roles
from patronage.functions.dates import date_column, elapsed_units, moment, unit_days
from patronage.functions.parse import is_complaint, is_purchase
from patronage.functions.value import recovery_rules
from patronage.operators.summaries import When, drop_incomplete


def complaint_summary(df: DataFrame, customer: str, date: str, event_type: str, end: When = None,
                      unit: str = "weeks", drop_after_end: bool = False) -> DataFrame:
    """Six figures per customer with at least one purchase.

    Repeat purchases, complaints on a day with a purchase, other complaints, time of the last event of
    any type, whether a complaint stands at that very moment, and the observation length; times run
    from the first purchase.

    Two aggregations in a row: first to (customer, day), then to customer. Both keep partial results
    where the rows lie, so a customer with most of the events stays cheap and no window is needed.
    """
    require_distinct_roles({"customer": customer, "event date": date, "event type": event_type})
    unit_days(unit)
    rows = drop_incomplete(df.select(
        field(customer).alias("_customer"),
        date_column(df, date).alias("_at"),
        is_purchase(field(event_type)).alias("_buy"),
        is_complaint(field(event_type)).alias("_moan"),
    ), "_customer", "_at")
    if drop_after_end and end is not None:
        rows = rows.where(F.col("_at") <= moment(end))
    final = moment(end) if end is not None else rows.agg(F.max("_at")).scalar()

    # A complaint stands at the last moment exactly when the last complaint is as late as the last event.
    # All totals are fixed-width numbers, so both steps stay hash aggregations.
    per_day = rows.groupBy("_customer", F.to_date("_at").alias("_day")).agg(
        F.count_if("_buy").alias("buys"),
        F.count_if("_moan").alias("moans"),
        F.min(F.when(F.col("_buy"), F.col("_at"))).alias("first_buy"),
        F.max("_at").alias("last_event"),
        F.max(F.when(F.col("_moan"), F.col("_at"))).alias("last_moan"),
    )
    per_customer = per_day.groupBy("_customer").agg(
        F.sum("buys").alias("buys"),
        F.sum(F.when(F.col("buys") > 0, F.col("moans")).otherwise(0)).alias("with_buy"),
        F.sum(F.when(F.col("buys") == 0, F.col("moans")).otherwise(0)).alias("alone"),
        F.min("first_buy").alias("first_buy"),
        F.max("last_event").alias("last_event"),
        F.max("last_moan").alias("last_moan"),
    ).where(F.col("buys") > 0).withColumn("_end", final)
    return per_customer.select(
        F.col("_customer").alias(customer),
        (F.col("buys") - 1).alias("xp_repeat_purchases"),
        F.col("with_buy").alias("xc_given_p_same_day_complaints"),
        F.col("alone").alias("xc_other_complaints"),
        elapsed_units(F.col("last_event"), F.col("first_buy"), unit).alias("tx_last_event"),
        F.coalesce(F.col("last_moan") == F.col("last_event"), F.lit(False)).cast("int").alias("zc_last_event_involves_complaint"),
        elapsed_units(F.col("_end"), F.col("first_buy"), unit).alias("T_observation_length"),
    )


def recovery_value(df: DataFrame, future, p_recovered, p_unrecovered, cost=0.0,
                   on_invalid: str = "null") -> DataFrame:
    """Adds what a recovery is worth per row: value with and without it, the most it may cost, the rest."""
    v, p, q, c = (as_column(a).cast("double") for a in (future, p_recovered, p_unrecovered, cost))
    rules = recovery_rules(future, p_recovered, p_unrecovered)
    with_it, without = guarded(v * p, rules, on_invalid), guarded(v * q, rules, on_invalid)
    return df.withColumns({
        "clv_if_recovered": with_it,
        "clv_if_unrecovered": without,
        "maximum_financially_justified_recovery_cost": with_it - without,
        "entered_recovery_cost": c,
        "net_value_of_recovery": with_it - without - c,
    })
