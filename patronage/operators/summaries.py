"""From logs to the per-customer and per-period tables the models read.

Every operator is one or two hash aggregations with map-side partial results, so a customer who
holds a third of the log is merged where the rows lie. No window runs over a customer's raw rows.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.columns import field, guarded, names, require_columns, require_distinct_roles
from patronage.errors import InputProblem
from patronage.functions.dates import date_column, elapsed_days, elapsed_units, moment, unit_days
from patronage.functions.parse import number_column
from patronage.operators.markov import complete_transitions
from patronage.operators.ranking import distributed_rank
from patronage.scratch import discard, stored
from patronage.shares import dealt

# Length of one period as a calendar step.
PERIOD_STEPS = {"year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days", "day": "1 day"}

# Consecutive rows that one window looks at.
BLOCK = 65_536

When = str | dt.date | dt.datetime | None


def drop_incomplete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every named column is present (NaN is missing)."""
    require_columns(df, *columns)
    kept = F.lit(True)
    for c in columns:
        kept = kept & field(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            kept = kept & ~F.isnan(field(c))
    return df.where(kept)


def _log(df: DataFrame, customer: str, date: str, *others: Column) -> DataFrame:
    """The needed columns only: customer, readable date, others. A batch log without one usable row is an error.

    ``prep.unreadable_rows`` counts the rows that are left out. A stream's log may be empty.
    """
    rows = _readable(df, customer, date, *others)
    if not df.isStreaming:
        _refuse_empty(rows, customer, date)
    return rows


def _readable(df: DataFrame, customer: str, date: str, *others: Column) -> DataFrame:
    rows = df.select(field(customer).alias("_customer"), date_column(df, date).alias("_at"), *others)
    return drop_incomplete(rows, "_customer", "_at")


def _refuse_empty(rows: DataFrame, customer: str, date: str) -> None:
    if rows.isEmpty():
        raise InputProblem(f"No row has both a '{customer}' and a readable date in '{date}'.",
                           "prep.unreadable_rows shows what could not be read.")


def _period_start(unit: str, at: Column) -> Column:
    return F.date_trunc(unit, at).cast("timestamp_ntz")


def _last(rows: DataFrame, end: When) -> Column:
    """Observation end: the given moment, else the latest date as a scalar subquery."""
    return moment(end) if end is not None else rows.agg(F.max("_at")).scalar()


def purchase_totals(df: DataFrame, customer: str, date: str, amount: str | None = None) -> DataFrame:
    """Mergeable totals per customer: first and last purchase, rows, and money if ``amount`` is given.

    These totals of two parts of a log add up to the totals of the whole, so they also serve a stream.
    """
    money = [] if amount is None else [number_column(df, amount).alias("_amount")]
    rows = _log(df, customer, date, *money)
    totals = [F.min("_at").alias("first_purchase"), F.max("_at").alias("last_purchase"),
              F.count("*").alias("purchase_count")]
    if amount is not None:
        rows = rows.where(F.col("_amount").isNotNull())
        totals.append(F.sum("_amount").alias("monetary_total"))
    return rows.groupBy(F.col("_customer").alias(customer)).agg(*totals)


def rfm_from_totals(totals: DataFrame, customer: str, start: Column, end: Column) -> DataFrame:
    """RFM inputs from ``purchase_totals`` for a log that runs from ``start`` to ``end``."""
    month = unit_days("months")
    months = F.greatest(elapsed_days(end, start) / F.lit(month), F.lit(1 / month))
    return totals.select(
        field(customer),
        "last_purchase",
        "purchase_count",
        (F.col("monetary_total") / F.col("purchase_count")).alias("monetary_average"),
        "monetary_total",
        elapsed_days(end, F.col("last_purchase")).alias("recency_days"),
        (F.col("purchase_count") / months).alias("frequency_per_month"),
    )


def _keep_until(rows: DataFrame, end: When, drop_after_end: bool) -> DataFrame:
    return rows.where(F.col("_at") <= moment(end)) if drop_after_end and end is not None else rows


def rfm_from_transactions(
    df: DataFrame,
    customer: str,
    date: str,
    amount: str,
    observation_date: When = None,
    drop_after_end: bool = False,
) -> DataFrame:
    """RFM inputs per customer from a purchase log.

    Purchases are rows: two on one day are two. Frequency is per month of the whole log, not of the
    customer. Rows after ``observation_date`` stay (recency turns negative) unless ``drop_after_end``.
    """
    require_distinct_roles({"customer": customer, "date": date, "amount": amount})
    rows = _log(df, customer, date, number_column(df, amount).alias("_amount"))
    rows = _keep_until(rows.where(F.col("_amount").isNotNull()), observation_date, drop_after_end)
    # Both ends of the log come from one more column-pruned scan that needs no shuffle of rows.
    ends = rows.agg(F.struct(F.min("_at").alias("start"), F.max("_at").alias("end"))).scalar()
    last = moment(observation_date) if observation_date is not None else F.col("_ends.end")
    totals = purchase_totals(rows, "_customer", "_at", "_amount").withColumn("_ends", ends)
    return rfm_from_totals(totals.withColumnRenamed("_customer", customer), customer,
                           F.col("_ends.start"), last)


def bgnbd_from_totals(totals: DataFrame, customer: str, end: Column, unit: str = "weeks") -> DataFrame:
    """x, tx, T per customer from ``purchase_totals``."""
    first = F.col("first_purchase")
    return totals.select(
        field(customer),
        (F.col("purchase_count") - 1).alias("x"),
        elapsed_units(F.col("last_purchase"), first, unit).alias("tx"),
        elapsed_units(end, first, unit).alias("T"),
    )


def bgnbd_summary(df: DataFrame, customer: str, date: str, end: When = None, unit: str = "weeks",
                  drop_after_end: bool = False) -> DataFrame:
    """Repeat purchases x, time of the last one tx and observation length T, from the first purchase."""
    require_distinct_roles({"customer": customer, "date": date})
    unit_days(unit)
    rows = _keep_until(_log(df, customer, date), end, drop_after_end)
    totals = purchase_totals(rows, "_customer", "_at").withColumnRenamed("_customer", customer)
    totals = totals.withColumn("_end", _last(rows, end))
    return bgnbd_from_totals(totals, customer, F.col("_end"), unit)


def binary_periods(df: DataFrame, customer: str, date: str, unit: str, periods: Sequence) -> DataFrame:
    """One 0/1 column per named period (``year``, ``quarter``, ``month`` ... of the date).

    ``periods`` are the period starts as dates; naming them keeps the pivot a single aggregation.
    Customers active only outside them get a row of zeros.
    """
    starts = [dt.date.fromisoformat(p) if isinstance(p, str) else p for p in periods]
    rows = _log(df, customer, date)
    period = _period_start(unit, F.col("_at")).cast("date")
    flags = [F.max(F.when(period == F.lit(p), 1).otherwise(0)).alias(f"p_{p.isoformat()}") for p in starts]
    return rows.groupBy(F.col("_customer").alias(customer)).agg(*flags)


def bgbb_summary(df: DataFrame, period_columns: Sequence[str], on_invalid: str = "error") -> DataFrame:
    """Adds n, tx, x from 0/1 period columns in time order; a missing flag is 0."""
    if not period_columns:
        raise InputProblem("No period columns were given.", "Name one 0/1 column per period, oldest first.")
    require_columns(df, *period_columns)
    flags = [F.coalesce(number_column(df, c), F.lit(0.0)) for c in period_columns]
    clean = F.lit(True)
    for f in flags:
        clean = clean & ((f == 0) | (f == 1))
    rule = [(clean, "period columns must hold only 0 and 1")]
    last = F.greatest(F.lit(0), *[F.when(f == 1, i).otherwise(0) for i, f in enumerate(flags, 1)])
    bought = sum(flags[1:], flags[0])
    return df.withColumns({
        "n": F.lit(len(flags)),
        "tx": guarded(last, rule, on_invalid).cast("int"),
        "x": guarded(bought, rule, on_invalid).cast("int"),
    })


def compress_histories(df: DataFrame, columns: Sequence[str], weight: str | None = None,
                       into: str = "weight") -> DataFrame:
    """Equal histories as one row with their summed weight. A missing weight counts 0."""
    require_columns(df, *columns)
    amount = F.lit(1.0) if weight is None else F.coalesce(number_column(df, weight), F.lit(0.0))
    return df.groupBy(*map(field, columns)).agg(F.sum(amount).alias(into))


def active_customers_per_period(df: DataFrame, customer: str, date: str, unit: str,
                                keys: str | Sequence[str] | None = None, before: When = None) -> DataFrame:
    """Customers with at least one row per period (0, 1, 2, ... from the first period of the log).

    Periods nobody was active in are filled with 0, per segment of ``keys``. ``before`` ends the log, for instance where
    its last period is not over.
    """
    keys = names(keys)
    rows = _log(df, customer, date, *map(field, keys))
    if before is not None:
        rows = rows.where(F.col("_at") < moment(before))
    starts = rows.select(*map(field, keys), "_customer", _period_start(unit, F.col("_at")).alias("_period"))
    step = PERIOD_STEPS.get(unit)
    if step is None:
        raise InputProblem(f"Unknown period unit {unit!r}.", f"Use one of {', '.join(PERIOD_STEPS)}.")
    # Distinct pairs first: a very active customer shrinks to one row per period before the shuffle.
    counts = starts.distinct().groupBy(*map(field, keys), "_period").agg(F.count("*").alias("_n"))
    ends = rows.agg(F.struct(_period_start(unit, F.min("_at")).alias("first"),
                             _period_start(unit, F.max("_at")).alias("last"))).scalar()
    # One row per (segment, period) is left, so a segment's counts fit a map as long as the calendar.
    packed = counts.groupBy(*map(field, keys)).agg(
        F.map_from_entries(F.collect_list(F.struct("_period", "_n"))).alias("_counts")).withColumn("_ends", ends)
    calendar = F.sequence(F.col("_ends.first"), F.col("_ends.last"), F.expr(f"interval {step}"))
    return packed.select(*map(field, keys), "_counts", F.posexplode(calendar).alias("period", "period_start")).select(
        *map(field, keys), "period", "period_start",
        F.coalesce(F.try_element_at("_counts", F.col("period_start")), F.lit(0)).alias("customers"))


def survivor_curve(df: DataFrame, cohort: str, last_period: str, horizon: str, on_invalid: str = "error") -> DataFrame:
    """(cohort, period, survivors): how many of a cohort reach period 0, 1, ... up to ``horizon``.

    One input row per customer: its cohort, the last period it reached (0-based, from the cohort's
    start) and the cohort's last observable period. Both must be known and not negative: a customer for whom
    they are not stops the job, or with ``on_invalid='null'`` is left out of the curve.
    """
    observable = field(horizon).cast("int")
    usable = F.coalesce((field(last_period) >= 0) & (field(horizon) >= 0), F.lit(False))
    if on_invalid == "error":
        usable = F.when(usable, True).otherwise(F.raise_error(F.lit(
            "a customer without a last period or horizon of 0 or more")).cast("boolean"))
    known = df.where(usable)
    rows = known.select(field(cohort).alias("_cohort"), observable.alias("_horizon"),
                        F.least(field(last_period).cast("int"), observable).alias("_last"))
    exits = rows.groupBy("_cohort", "_last").agg(F.count("*").alias("_n"), F.max("_horizon").alias("_horizon"))
    # One row per (cohort, exit period) is left: as many as the calendar has periods, not customers.
    packed = exits.groupBy("_cohort").agg(
        F.map_from_entries(F.collect_list(F.struct("_last", "_n"))).alias("_exits"),
        F.max("_horizon").alias("_horizon"))
    lost = packed.select("_cohort", "_exits", F.explode(F.sequence(F.lit(0), F.col("_horizon"))).alias("period"))
    later = W.partitionBy("_cohort").orderBy(F.desc("period")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return lost.select(
        F.col("_cohort").alias(cohort), "period",
        F.sum(F.coalesce(F.try_element_at("_exits", F.col("period")), F.lit(0))).over(later).alias("survivors"))


def acquired_customers(df: DataFrame, period: str, customers: str, retention: float,
                       keys: str | Sequence[str] | None = None, on_invalid: str = "error") -> DataFrame:
    """Adds ``acquired`` = N(t) − retention·N(t−1), from the second period on, in period order.

    Input: one row per period and segment, so the window runs over a period table, not over a log.
    """
    if not 0 <= retention <= 1:
        raise InputProblem("Retention must lie between 0 and 1.")
    keys = names(keys)
    now = number_column(df, customers)
    rows = df.withColumns({"_t": number_column(df, period), "_now": now}).where(
        F.col("_t").isNotNull() & F.col("_now").isNotNull())
    in_order = W.partitionBy(*map(field, keys)).orderBy("_t")
    rows = rows.withColumn("_before", F.lag("_now").over(in_order))
    raw = F.col("_now") - F.lit(float(retention)) * F.col("_before")
    # Fixed value: how far below zero rounding may push an acquisition count.
    rules = [((F.col("_now") >= 0) & (F.col("_before") >= 0), "customer counts must not be negative"),
             (raw >= -1e-8, "this retention implies negative acquisitions")]
    return (
        rows.where(F.col("_before").isNotNull())
        .withColumn("acquired", guarded(F.greatest(raw, F.lit(0.0)), rules, on_invalid))
        .drop("_t", "_now", "_before")
    )


def _with_next(placed: DataFrame, place: str, columns: Sequence[str], size: int) -> DataFrame:
    """Adds ``_block`` and ``_next``: the named columns of the row that follows in the order of ``place`` (1, 2, 3, ..., size).

    Blocks of consecutive places bound what a window holds. The first row of a block also closes the
    block before it, as a copy that is dropped again.
    """
    block = F.floor((F.col(place) - 1) / F.lit(BLOCK)).cast("long")
    opens = ((F.col(place) - 1) % F.lit(BLOCK) == 0) & (F.col(place) > 1)
    copies = F.when(opens, F.array(block, block - 1)).otherwise(F.array(block))
    in_blocks = dealt(placed.withColumn("_own", block).withColumn("_block", F.explode(copies)), size, "_block")
    following = F.lead(F.struct(*columns)).over(W.partitionBy("_block").orderBy(place))
    return in_blocks.withColumn("_next", following).where(F.col("_own") == F.col("_block")).drop("_own")


def estimate_transitions(df: DataFrame, customer: str, date: str, state: str, tiebreak: str,
                         scenario: str | None = None, absorbing: str = "stay", whole: bool = True) -> DataFrame:
    """Share of moves from one state to the next per customer: (scenario, from_state, to_state, moves, prob).

    The matrix is whole: pairs of a scenario's states that were never seen are 0; a state that no customer left leads to
    itself, or stops the job with ``absorbing='error'``. With ``whole=False`` only the pairs that were seen are
    returned, for ``sparse_markov.coordinate_matrix``.

    "Next" needs the rows of a customer in time order. A window per customer would put a hot customer
    into one task; instead rows are placed in order over (scenario, customer, time, tie-break) across
    the whole table, and looked at in blocks of equal length. Moves are counted per block first, so that a
    frequent move is one row of a block.
    """
    who = [] if scenario is None else [field(scenario).alias("_scenario")]
    readable = _readable(df, customer, date, field(state).alias("_state"), field(tiebreak).alias("_tie"), *who)
    rows = stored(drop_incomplete(readable, "_state"), "log")
    size = rows.count()
    # A log that is a join is worked out once; only one without a single state is asked whether it has other rows.
    if not size:
        _refuse_empty(readable, customer, date)
    same = ["_scenario", "_customer"] if who else ["_customer"]
    placed = distributed_rank(rows, [F.col(c) for c in (*same, "_at", "_tie")], "_place", size).drop("_at", "_tie")
    discard(rows)
    moves = _with_next(placed, "_place", [*same, "_state"], size)
    for c in same:
        moves = moves.where(F.col(c).eqNullSafe(F.col(f"_next.{c}")))
    keys = same[:-1]
    pair = [*keys, "from_state", "to_state"]
    per_block = moves.groupBy("_block", *keys, F.col("_state").alias("from_state"), F.col("_next._state").alias("to_state")).agg(
        F.count("*").alias("moves"))
    counts = dealt(per_block, size, *pair).groupBy(*pair).agg(F.sum("moves").alias("moves"))
    # One row per pair of states is left. Pairs never seen are 0, and states never left stay.
    total = F.sum("moves").over(W.partitionBy(*keys, "from_state"))
    shares = dealt(counts, size, *pair[:-1]).withColumn("prob", F.col("moves") / total)
    if not whole:
        return shares.withColumnRenamed("_scenario", scenario) if who else shares
    seen = stored(shares, "transitions")
    whole_matrix = complete_transitions(seen, keys, absorbing)
    right = seen.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(pair)], "moves")
    same = [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(pair)]
    out = whole_matrix.join(right, functools.reduce(Column.__and__, same), "left").select(
        *pair, F.coalesce("moves", F.lit(0).cast("long")).alias("moves"), "prob")
    return out.withColumnRenamed("_scenario", scenario) if who else out
