"""Summaries of logs: time of day, late rows, missing cells, and a customer who holds most of the log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from patronage.errors import InputProblem
from patronage.functions import dates, parse
from patronage.operators import complaints, summaries
from patronage.streaming import incremental

SMALL = "/root/testdata/sf0.001"


def log(spark, rows, schema="who string, day string, amount double"):
    return spark.createDataFrame(rows, schema)


def test_elapsed_days_round_down(spark):
    pairs = [("2025-01-02 01:00:00", "2025-01-01 23:00:00", 0), ("2025-01-01 23:00:00", "2025-01-02 01:00:00", -1),
             ("2025-01-03 00:00:00", "2025-01-01 00:00:00", 2), ("2025-01-01 00:00:00", "2025-01-03 00:00:00", -2),
             ("2025-03-31 12:00:00", "2025-03-29 12:00:01", 1)]
    df = spark.createDataFrame(pairs, "e string, s string, want int")
    got = df.select(dates.elapsed_days(F.col("e").cast("timestamp_ntz"), F.col("s").cast("timestamp_ntz")), "want")
    assert all(a == b for a, b in got.collect())
    with pytest.raises(InputProblem):
        dates.elapsed_units(F.lit(1), F.lit(1), "fortnights")


def test_elapsed_time_ignores_clock_changes(spark):
    """Wall-clock times, so a session zone with summer time changes nothing."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Oslo")
    try:
        df = log(spark, [("a", "2025-03-29 12:00:00", 1.0), ("a", "2025-03-30 12:00:00", 1.0)])
        assert summaries.bgnbd_summary(df, "who", "day", unit="days").first()["tx"] == 1.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rfm_inputs(spark):
    rows = [("a", "2025-01-01", 10.0), ("a", "2025-01-01", 20.0), ("a", "2025-03-01", 30.0), ("b", "01.02.2025", 5.0),
            ("b", "soon", 5.0), (None, "2025-01-05", 5.0), ("c", "2025-01-05", None)]
    got = {r["who"]: r for r in summaries.rfm_from_transactions(log(spark, rows), "who", "day", "amount").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["purchase_count"] == 3 and got["a"]["monetary_average"] == 20 and got["a"]["monetary_total"] == 60
    assert (got["a"]["recency_days"], got["b"]["recency_days"]) == (0, 28)
    assert got["a"]["frequency_per_month"] == pytest.approx(3 / (59 / 30.4375))
    late = summaries.rfm_from_transactions(log(spark, rows), "who", "day", "amount", "2025-02-10").collect()
    assert {r["who"]: r["recency_days"] for r in late} == {"a": -19, "b": 9}
    cut = summaries.rfm_from_transactions(log(spark, rows), "who", "day", "amount", dt.date(2025, 2, 10), True)
    assert {r["who"]: r["recency_days"] for r in cut.collect()} == {"a": 40, "b": 9}
    one_day = summaries.rfm_from_transactions(log(spark, rows[:2]), "who", "day", "amount").first()
    assert one_day["frequency_per_month"] == pytest.approx(2 * 30.4375)
    with pytest.raises(InputProblem):
        summaries.rfm_from_transactions(log(spark, rows), "who", "day", "day")


def test_bgnbd_inputs(spark):
    rows = [("a", "2025-01-01 08:00:00", 0.0), ("a", "2025-01-15 07:00:00", 0.0), ("b", "2025-01-08 00:00:00", 0.0)]
    got = {r["who"]: r for r in summaries.bgnbd_summary(log(spark, rows), "who", "day", "2025-02-01").collect()}
    assert (got["a"]["x"], got["a"]["tx"], got["a"]["T"]) == (1, 13 / 7, 30 / 7)
    assert (got["b"]["x"], got["b"]["tx"], got["b"]["T"]) == (0, 0.0, 24 / 7)


def test_period_flags_and_summary(spark):
    rows = [("a", "2024-01-05", 1.0), ("a", "2024-03-05", 1.0), ("b", "2023-12-31", 1.0)]
    flags = summaries.binary_periods(log(spark, rows), "who", "day", "month", ["2024-01-01", "2024-02-01", "2024-03-01"])
    columns = [c for c in flags.columns if c != "who"]
    got = {r["who"]: (r["n"], r["tx"], r["x"]) for r in summaries.bgbb_summary(flags, columns).collect()}
    assert got == {"a": (3, 3, 2), "b": (3, 0, 0)}
    dirty = spark.createDataFrame([(1, None, 1), (0, 2, 0)], "p int, q int, s int")
    kept = summaries.bgbb_summary(dirty, ["p", "q", "s"], "null").orderBy(F.desc("p")).collect()
    assert (kept[0]["tx"], kept[0]["x"]) == (3, 2) and kept[1]["x"] is None
    with pytest.raises(Exception, match="only 0 and 1"):
        summaries.bgbb_summary(dirty, ["p", "q", "s"]).collect()
    with pytest.raises(InputProblem):
        summaries.bgbb_summary(dirty, [])


def test_compression_counts_missing_weight_as_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, 5.0)], "x int, w double")
    got = {r["x"]: r["weight"] for r in summaries.compress_histories(df, ["x"], "w").collect()}
    assert got == {1: 2.0, 2: 5.0}


def test_periods_without_customers_are_zero(spark):
    rows = [("a", "2024-01-05", 1.0), ("b", "2024-01-07", 1.0), ("a", "2024-04-01", 1.0), ("a", "2024-04-02", 1.0)]
    got = summaries.active_customers_per_period(log(spark, rows), "who", "day", "month").orderBy("period").collect()
    assert [r["customers"] for r in got] == [2, 0, 0, 1]


def test_survivors(spark):
    df = spark.createDataFrame([("c", 0, 3), ("c", 2, 3), ("c", 2, 3), ("c", 9, 3), ("d", 1, 1)],
                               "cohort string, last int, horizon int")
    got = {(r["cohort"], r["period"]): r["survivors"] for r in
           summaries.survivor_curve(df, "cohort", "last", "horizon").collect()}
    assert got == {("c", 0): 4, ("c", 1): 3, ("c", 2): 3, ("c", 3): 1, ("d", 0): 1, ("d", 1): 1}


def test_acquisitions(spark):
    df = spark.createDataFrame([(2, 150.0), (0, 100.0), (1, 120.0)], "t int, n double")
    got = summaries.acquired_customers(df, "t", "n", 0.5).orderBy("t").collect()
    assert [r["acquired"] for r in got] == [70.0, 90.0]
    with pytest.raises(Exception, match="negative acquisitions"):
        summaries.acquired_customers(df.withColumn("n", -F.col("t") + 10), "t", "n", 1.0).collect()
    with pytest.raises(InputProblem):
        summaries.acquired_customers(df, "t", "n", 1.5)


EVENTS = [("A", "purchase", "2025-01-01"), ("A", "purchase", "2025-02-01"), ("A", "complaint", "2025-02-01"),
          ("A", "complaint", "2025-03-15"), ("B", "purchase", "2025-01-10"), ("B", "purchase", "2025-04-10"),
          ("C", "purchase", "2025-01-20"), ("C", "complaint", "2025-01-25")]


def test_complaint_example(spark):
    df = spark.createDataFrame(EVENTS, "who string, kind string, day string")
    got = {r["who"]: r for r in complaints.complaint_summary(df, "who", "day", "kind", "2025-06-01").collect()}
    a = got["A"]
    assert (a["xp_repeat_purchases"], a["xc_given_p_same_day_complaints"], a["xc_other_complaints"]) == (1, 1, 1)
    assert a["zc_last_event_involves_complaint"] == 1 and a["tx_last_event"] == pytest.approx(73 / 7)
    assert a["T_observation_length"] == pytest.approx(151 / 7)
    assert (got["B"]["xp_repeat_purchases"], got["B"]["zc_last_event_involves_complaint"]) == (1, 0)


def brute_complaints(rows):
    """The six figures by plain loops; times in days."""
    out = {}
    end = max(t for _, _, t in rows)
    for who in {w for w, _, _ in rows}:
        own = [(t, (k or "none").strip().lower()) for w, k, t in rows if w == who]
        buys = [t for t, k in own if "purchase" in k or "order" in k]
        moans = [t for t, k in own if "complaint" in k]
        if not buys:
            continue
        same = sum(t.date() in {b.date() for b in buys} for t in moans)
        last = max(t for t, _ in own)
        out[who] = (len(buys) - 1, same, len(moans) - same, (last - min(buys)).days,
                    int(any("complaint" in k for t, k in own if t == last)), (end - min(buys)).days)
    return out


def test_complaints_against_brute_force(spark):
    """One customer holds a third of the events; types are missing, mixed or both at once."""
    import random
    g = random.Random(4)
    kinds = ["Purchase", "reorder", " COMPLAINT", "complaint about order", "view", None]
    rows = [(0 if g.random() < 0.34 else g.randrange(1, 60), g.choice(kinds),
             dt.datetime(2025, 1, 1) + dt.timedelta(hours=g.randrange(0, 24 * 40))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "who int, kind string, at timestamp_ntz").repartition(9)
    got = {r["who"]: tuple(r[c] for c in (
        "xp_repeat_purchases", "xc_given_p_same_day_complaints", "xc_other_complaints", "tx_last_event",
        "zc_last_event_involves_complaint", "T_observation_length"))
        for r in complaints.complaint_summary(df, "who", "at", "kind", unit="days").collect()}
    assert got == brute_complaints(rows)


def test_hot_customer_needs_no_window(spark):
    """The plans of the log summaries hold no window and no sort of a customer's rows."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    for df in (complaints.complaint_summary(events, "user_id", "ts", "event_type"),
               summaries.bgnbd_summary(orders, "o_custkey", "o_orderdate"),
               summaries.rfm_from_transactions(orders, "o_custkey", "o_orderdate", "o_totalprice")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "partial_" in plan


def test_only_needed_columns_are_read(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = summaries.bgnbd_summary(orders, "o_custkey", "o_orderdate")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan
    assert "IsNotNull(o_custkey)" in plan


def test_event_words(spark):
    df = spark.createDataFrame([("Reorder ",), ("complaint on purchase",), (None,), ("view",)], "k string")
    got = [tuple(r[0]) for r in df.select(parse.classify_event(F.col("k"))).collect()]
    assert got == [(True, False), (True, True), (False, False), (False, False)]


def test_stream_in_several_batches(spark, tmp_path):
    """The log arrives in three parts; the totals equal those of the whole."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    checkpoint = str(tmp_path / "check")
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(orders.schema).parquet(source)
        incremental.stream_totals(stream, "o_custkey", "o_orderdate", "o_totalprice", out, checkpoint).awaitTermination()
    totals = incremental.current_totals(incremental.read_updates(spark, out), "o_custkey")
    got = {r["o_custkey"]: r for r in incremental.rfm_now(totals, "o_custkey").collect()}
    want = summaries.rfm_from_transactions(orders, "o_custkey", "o_orderdate", "o_totalprice").collect()
    assert len(got) == len(want)
    for r in want:
        mine = got[r["o_custkey"]].asDict()
        assert mine.pop("monetary_total") == pytest.approx(r["monetary_total"])
        assert mine.pop("monetary_average") == pytest.approx(r["monetary_average"])
        assert all(mine[k] == r[k] for k in mine)
    nbd = {r["o_custkey"]: r for r in incremental.bgnbd_now(totals, "o_custkey").collect()}
    for r in summaries.bgnbd_summary(orders, "o_custkey", "o_orderdate").collect():
        assert nbd[r["o_custkey"]] == r
    with pytest.raises(InputProblem):
        incremental.stream_totals(orders, "o_custkey", "o_orderdate", "o_totalprice", out)
