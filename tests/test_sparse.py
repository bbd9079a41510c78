"""Cases that once gave wrong or empty results: sparse matrices, text dates, missing keys, empty logs."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.errors import InputProblem
from patronage.operators import markov, sparse_markov, summaries
from patronage.plans import newton, response_models
from patronage.scratch import SETTING, clear_scratch, scratch_folder, stored
from patronage.sources import readers, sinks

RING = [("A", "B", 1.0), ("B", "C", 1.0), ("C", "A", 0.5), ("C", "C", 0.5)]


def ring(spark, keys=None):
    df = spark.createDataFrame(RING, "from_state string, to_state string, prob double")
    return df if keys is None else df.crossJoin(spark.createDataFrame([(k,) for k in keys], "scenario string"))


def test_missing_pairs_are_zero(spark):
    packed = markov.pack_transitions(ring(spark))
    got = {(r["previous"], r["occasion"], r["state"]): r["probability"]
           for r in markov.choice_probabilities(packed, None, F.lit(2)).collect()}
    assert got["A", 0, "B"] == 1 and got["A", 0, "A"] == 0 and got["A", 1, "C"] == 1
    assert got["C", 1, "B"] == 0.5 and got["C", 1, "A"] == 0.25
    joined = {(r["previous"], r["occasion"], r["state"]): r["probability"]
              for r in sparse_markov.sparse_choice_probabilities(sparse_markov.coordinate_matrix(ring(spark)), None, 2).collect()}
    assert joined == {k: v for k, v in got.items() if v}
    one = sparse_markov.sparse_choice_probabilities(sparse_markov.coordinate_matrix(ring(spark)), "C", 2).collect()
    assert {r["previous"] for r in one} == {"C"} and len(one) == len([k for k in joined if k[0] == "C"])
    value = markov.markov_clv(packed, "A", "C", 1.0, 1.0, 1.0, 0.0, 1.0).first()["clv"]
    assert value == pytest.approx(1.0)


def test_states_that_are_never_left(spark):
    df = spark.createDataFrame([("A", "B", 1.0)], "from_state string, to_state string, prob double")
    got = {(r[0], r[1]): r[2] for r in markov.complete_transitions(df).collect()}
    assert got == {("A", "A"): 0, ("A", "B"): 1, ("B", "A"): 0, ("B", "B"): 1}
    with pytest.raises(Exception, match="leads away from state B"):
        markov.complete_transitions(df, absorbing="error").collect()
    log = spark.createDataFrame([(1, "2020-01-01", "A", 1), (1, "2020-01-02", "B", 2)], "who int, at string, state string, tie int")
    estimates = summaries.estimate_transitions(log, "who", "at", "state", "tie")
    assert markov.validate_transitions(estimates).count() == 4


@pytest.mark.parametrize("n", [10, 70, 150])
def test_any_number_of_states(spark, n):
    """A cycle through all states, below and above what was once the most."""
    df = spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)], "from_state int, to_state int, prob double")
    rows = markov.choice_probabilities(markov.pack_transitions(df), 0, F.lit(2)).where("probability > 0").collect()
    assert [(r["occasion"], r["state"], r["probability"]) for r in rows] == [(0, 1, 1.0), (1, 2, 1.0)]


TERMS = (120.0, 0.25, 2.0, 0.1, 2.0)


def test_packed_and_sparse_agree(spark):
    """Value and return of small matrices, with scenarios of which one has no name, in both forms."""
    keyed = ring(spark, ["x", None])
    better = keyed.withColumn("prob", F.col("prob") * 0.5).unionByName(keyed.select("from_state").distinct().crossJoin(
        keyed.select("scenario").distinct()).select("from_state", F.lit("B").alias("to_state"), F.lit(0.5).alias("prob"), "scenario")) \
        .groupBy("scenario", "from_state", "to_state").agg(F.sum("prob").alias("prob"))
    for keys, old, new in ((None, ring(spark), better.where("scenario = 'x'").drop("scenario")), ("scenario", keyed, better)):
        packed, sparse = markov.pack_transitions(old, keys), sparse_markov.coordinate_matrix(old, keys)
        for details in (False, True):
            a = markov.markov_clv(packed, None, "B", *TERMS, keys=keys, details=details)
            b = sparse_markov.sparse_markov_clv(sparse, None, "B", *TERMS, keys=keys, details=details)
            assert a.columns == b.columns
            for x, y in zip(sorted(map(tuple, a.collect()), key=repr), sorted(map(tuple, b.collect()), key=repr)):
                assert x[:-1][:2] == y[:-1][:2] and x[-1] == pytest.approx(y[-1], abs=1e-12)
    one = (ring(spark), better.where("scenario = 'x'").drop("scenario"))
    weights = spark.createDataFrame([("A", 1), ("B", 3), ("C", 6)], "state string, weight int")
    a = markov.markov_roi(*[markov.pack_transitions(m) for m in one], weights, "B", *TERMS, 1000.0, 500.0).first()
    b = sparse_markov.sparse_markov_roi(*[sparse_markov.coordinate_matrix(m) for m in one], weights, "B", *TERMS, 1000.0, 500.0).first()
    assert a.asDict() == pytest.approx(b.asDict(), rel=1e-12) and a["roi"] > 0
    short = weights.where("state <> 'A'")
    with pytest.raises(Exception, match="same states"):
        sparse_markov.sparse_markov_roi(*[sparse_markov.coordinate_matrix(m) for m in one], short, "B", *TERMS, 1000.0, 500.0).collect()


def test_ten_thousand_states(spark):
    """A ring of 10,000 states in which a third of all moves goes to one state: paths, value and return without a matrix in a row."""
    n = 10_000
    ends = spark.range(n).select(F.col("id").alias("from_state"), F.explode(F.array(
        F.struct(((F.col("id") + 1) % n).alias("to_state"), F.lit(0.5).alias("prob")),
        F.struct(((F.col("id") + 2) % n).alias("to_state"), F.lit(0.25).alias("prob")),
        F.struct(F.lit(0).cast("long").alias("to_state"), F.lit(0.25).alias("prob")))).alias("c")).select("from_state", "c.*") \
        .groupBy("from_state", "to_state").agg(F.sum("prob").alias("prob"))
    old = sparse_markov.coordinate_matrix(ends)
    assert old.count() == ends.count() and "array" not in str(old.schema)
    path = sparse_markov.sparse_choice_probabilities(old, 5_000, 3).collect()
    assert sum(r.probability for r in path if r.occasion == 2) == pytest.approx(1, abs=1e-12)
    assert {r.state: r.probability for r in path if r.occasion == 1}[0] == 0.25
    values = {r.previous: r.clv for r in sparse_markov.sparse_markov_clv(old, None, 0, 100.0, 0.5, 1.0, 0.1, 2.0).collect()}
    # Far from 0 every step leads there with 1/4.
    assert len(values) == n and values[5_000] == pytest.approx(12.5 * (1 + 1 / 1.1 + 1 / 1.21), abs=1e-9)
    kept = ends.where("to_state <> 0").withColumn("prob", F.col("prob") / 2).unionByName(
        spark.range(n).select(F.col("id").alias("from_state"), F.lit(0).cast("long").alias("to_state"), F.lit(0.0).alias("prob")))
    total = kept.groupBy("from_state").agg(F.sum("prob").alias("s"))
    new = sparse_markov.coordinate_matrix(kept.join(total, "from_state").withColumn(
        "prob", F.when(F.col("to_state") == 0, 1 - F.col("s")).otherwise(F.col("prob"))).drop("s"))
    weights = spark.range(n).select(F.col("id").alias("state"), F.lit(1).alias("weight"))
    roi = sparse_markov.sparse_markov_roi(old, new, weights, 0, 100.0, 0.5, 1.0, 0.1, 2.0, 1000.0, 100.0).first()
    assert roi["old_average_clv"] == pytest.approx(sum(values.values()) / n) and roi["new_average_clv"] > roi["old_average_clv"]


def test_coordinates_are_checked(spark):
    schema = "from_state string, to_state string, prob double"
    for rows, problem in (([("A", "B", 1.5)], "between 0 and 1"), ([("A", "B", None)], "between 0 and 1"),
                          ([("A", "B", 0.5)], "sum to 1"), ([("A", "B", 0.5), ("A", "B", 0.5)], "square")):
        with pytest.raises(Exception, match=problem):
            sparse_markov.coordinate_matrix(spark.createDataFrame(rows, schema))
    with pytest.raises(Exception, match="leads away from state B"):
        sparse_markov.coordinate_matrix(spark.createDataFrame([("A", "B", 1.0)], schema), absorbing="error")
    stays = sparse_markov.coordinate_matrix(spark.createDataFrame([("A", "B", 1.0), ("A", "C", 0.0)], schema)).collect()
    assert sorted((r.from_state, r.to_state, r.parts) for r in stays) == [("A", "B", 10**18), ("B", "B", 10**18), ("C", "C", 10**18)]
    ring_ = sparse_markov.coordinate_matrix(ring(spark))
    with pytest.raises(InputProblem):
        sparse_markov.sparse_choice_probabilities(ring_, "Z", 2)
    with pytest.raises(InputProblem):
        sparse_markov.focal_probabilities(ring_, "Z", 2)


def test_scenarios_without_a_name(spark):
    whole = markov.complete_transitions(ring(spark, ["x", None]), "scenario")
    assert markov.validate_transitions(whole, keys="scenario").count() == 18


def test_own_files_are_read_back(spark, tmp_path):
    log = spark.createDataFrame([(k % 5, f"2020-01-{k + 1:02d} 10:30:00", float(k)) for k in range(20)],
                                "who int, at string, paid double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    sinks.write_table(log, str(tmp_path / "log"), "csv")
    again = readers.read_csv_table(spark, str(tmp_path / "log"))
    def both(df):
        return sorted(tuple(map(str, r)) for r in summaries.rfm_from_transactions(df, "who", "at", "paid").collect())
    assert both(again.withColumn("who", F.col("who").cast("int"))) == both(log)


def test_empty_logs_are_an_error(spark):
    log = spark.createDataFrame([(1, "soon", 1.0)], "who int, at string, paid double")
    for call in (lambda: summaries.rfm_from_transactions(log, "who", "at", "paid"),
                 lambda: summaries.bgnbd_summary(log, "who", "at"),
                 lambda: summaries.active_customers_per_period(log, "who", "at", "month")):
        with pytest.raises(InputProblem, match="readable date"):
            call()


def test_no_customer_leaves_a_curve_unseen(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", None, 3), ("a", -1, 3), ("a", 2, 3)], "cohort string, last int, horizon int")
    with pytest.raises(Exception, match="last period"):
        summaries.survivor_curve(df, "cohort", "last", "horizon").collect()
    left = summaries.survivor_curve(df, "cohort", "last", "horizon", on_invalid="null").where("period = 0").first()
    assert left["survivors"] == 2


def test_every_start_runs_to_its_end():
    """Two hills: the start that looks hopeless at first ends on the higher one."""
    import numpy as np

    def hills(points):
        out = []
        for (x,) in points:
            low, high = np.exp(-(x + 3) ** 2 / 2), 2 * np.exp(-(x - 6) ** 2 / 8)
            g = -(x + 3) * low - (x - 6) / 4 * high
            h = ((x + 3) ** 2 - 1) * low + ((x - 6) ** 2 / 16 - 0.25) * high
            out.append((low + high, np.array([g]), np.array([[h]])))
        return out

    best = newton.maximise(hills, [[-3.1], [1.0]], [-20.0], [20.0])
    assert best.converged and best.value == pytest.approx(2, abs=1e-6)


def test_tree_cuts_come_from_all_rows(spark):
    """Many more rows than bins squared used to allow, few values: the cut is the exact one."""
    df = spark.range(600_000).select(((F.col("id") % 202) * 0.1).alias("x")).withColumn(
        "y", (F.col("x") > 2.55).cast("int"))
    model = response_models.fit_decision_tree(df, "y", ["x"], max_depth=1)
    assert "x <= 2.5500" in model.rules


def test_scratch_leaves_the_session_alone(spark):
    before = spark.conf.get(SETTING)
    table = stored(spark.range(5).toDF("n"), "numbers")
    assert table.count() == 5 and spark.conf.get(SETTING) == before
    assert spark.sparkContext.applicationId in scratch_folder(spark)
    assert scratch_folder(spark).startswith(before) and callable(clear_scratch)


def test_any_number_of_values_and_levels(spark):
    """300,000 distinct values are cut at the very gap, and one of 20,000 levels is found."""
    df = spark.range(300_000).select(((F.col("id") * 7919) % 300_000).cast("double").alias("x"), F.concat(
        F.lit("s"), (F.col("id") % 20_000).cast("string")).alias("shop"))
    model = response_models.fit_decision_tree(df.withColumn("y", (F.col("x") > 123_456).cast("int")), "y", ["x", "shop"], 1, 5)
    assert "x <= 123456.5000" in model.rules
    answers = df.withColumn("y", F.when(F.col("shop") == "s77", 1).otherwise((F.col("x") < 3).cast("int")))
    model = response_models.fit_decision_tree(answers, "y", ["x", "shop"], 1, 5)
    assert "shop_s77 <= 0.5000" in model.rules and model.feature_importance.count() == 20_001


def test_a_long_vector_stays_out_of_the_driver(spark, monkeypatch):
    """Every state leads to -1 and to the next one: copies of a long vector are no broadcast, and both ways to join give the same."""
    n = 70_000
    matrix = sparse_markov.coordinate_matrix(spark.range(1, n).select(F.col("id").alias("from_state"), F.explode(F.array(
        F.struct(((F.col("id") + 1) % n).alias("to_state"), F.lit(0.5).alias("prob")),
        F.struct(F.lit(-1).cast("long").alias("to_state"), F.lit(0.5).alias("prob")))).alias("c")).select("from_state", "c.*"))
    vector = stored(matrix.groupBy(F.col("to_state").alias("state")).agg(F.max("parts").alias("parts")), "vector")

    def step():
        return sparse_markov._times(vector, matrix, [], "to_state", "from_state")

    plan = step()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    sums = [F.count("*"), *[F.sum(c.cast("decimal(20, 0)")) for c in (F.col("parts"), F.xxhash64("state", "parts"))]]
    long_ = step().groupBy().agg(*sums).first()
    monkeypatch.setattr(sparse_markov, "SENT_ROWS", n + 2)
    assert "BroadcastHashJoin" in step()._jdf.queryExecution().executedPlan().toString()
    assert step().groupBy().agg(*sums).first() == long_ and long_[0] == n + 1


def test_shares_of_a_long_log_stay_short(spark):
    """4.4M purchases of 1,000 customers, one of whom holds a third: more tasks than the setting names, and every move counted."""
    n = 4_400_000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1_000).alias("customer"),
        F.timestamp_seconds(F.col("id")).alias("at"), (F.col("id") % 7).alias("state"), F.col("id").alias("tie"))
    moves = summaries.estimate_transitions(log, "customer", "at", "state", "tie", whole=False)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8" and moves.rdd.getNumPartitions() >= 9
    got = {(r.from_state, r.to_state): (r.moves, r.prob) for r in moves.collect()}
    assert sum(m for m, _ in got.values()) == n - 1_000
    following = F.lead("state").over(W.partitionBy("customer").orderBy("at"))
    want = log.withColumn("to_state", following).where("to_state IS NOT NULL").groupBy("state", "to_state").count().collect()
    assert {k: m for k, (m, _) in got.items()} == {(r["state"], r.to_state): r["count"] for r in want}
    assert all(sum(p for (s, _), (_, p) in got.items() if s == state) == pytest.approx(1) for state in range(7))


def test_return_on_a_campaign_that_reaches_every_state(spark, monkeypatch):
    """70,000 states, all of which the campaign leads to the focal brand: no step of either value sends copies to all tasks."""
    n, plans = 70_000, []

    def kept(df, label):
        if label == "focal":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr(sparse_markov, "stored", kept)
    ring_ = spark.range(1, n).select(F.col("id").alias("from_state"), F.when(F.col("id") < n - 1, F.col("id") + 1).otherwise(0).alias("to_state"))
    old = sparse_markov.coordinate_matrix(ring_.withColumn("prob", F.lit(1.0)))
    new = sparse_markov.coordinate_matrix(ring_.where("to_state <> 0").withColumn("prob", F.lit(0.75)).unionByName(
        ring_.select("from_state", F.lit(0).cast("long").alias("to_state"), F.when(F.col("to_state") == 0, 1.0).otherwise(0.25).alias("prob"))))
    weights = spark.range(n).select(F.col("id").alias("state"), F.lit(1).alias("weight"))
    out = sparse_markov.sparse_markov_roi(old, new, weights, 0, 100.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0).first()
    assert len(plans) == 2 and "BroadcastHashJoin" in plans[0]
    assert "SortMergeJoin" in plans[1] and "BroadcastHashJoin" not in plans[1]
    # Two purchases: 1/4 and then 1/4 + 3/4 of 1/4, but for the last states of the ring.
    assert out["new_average_clv"] == pytest.approx(100 * (0.25 + 0.4375), abs=0.01)
    assert out["old_average_clv"] == pytest.approx(100 * (2 + 2 + 1) / n)


def test_no_table_of_states_is_sent_to_all_tasks(spark, monkeypatch):
    """70,000 states, few enough for Spark to broadcast: matrices, values and return join no table of them through the driver."""
    n, plans = 70_000, []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    def kept(df, label):
        if label == "matrix":
            ran(df)
        return stored(df, label)

    monkeypatch.setattr(sparse_markov, "stored", kept)
    # The last state is never left.
    cells = spark.range(n - 1).select(F.col("id").alias("from_state"), (F.col("id") + 1).alias("to_state"), F.lit(1.0).alias("prob"))
    matrix = sparse_markov.coordinate_matrix(cells)
    assert matrix.count() == n and matrix.where("from_state = to_state").first()["from_state"] == n - 1
    terms = (n - 1, 100.0, 1.0, 1.0, 0.0, 1.0)
    for details in (False, True):
        ran(sparse_markov.sparse_markov_clv(matrix, None, *terms, details=details))
    ran(sparse_markov.sparse_markov_roi(matrix, matrix, matrix.select(F.col("from_state").alias("state"), F.lit(1).alias("weight")), *terms, 1.0, 1.0))
    assert len(plans) == 4 and all("Broadcast" not in p for p in plans)
    value = sparse_markov.sparse_markov_clv(matrix, None, *terms)
    got = dict(value.where("clv > 0").collect())
    assert value.count() == n and got == {n - 1: 200.0, n - 2: 200.0, n - 3: 100.0}


@pytest.mark.parametrize("share", [None, 4])
def test_long_vectors_are_dealt_by_one_number(spark, monkeypatch, share):
    """A matrix with nameless keys and states, and a state that all others lead to: products are exact, dealt in shares and left to Spark."""
    import random

    from patronage import shares

    monkeypatch.setattr(sparse_markov, "MANY_CELLS", 20)
    if share:
        monkeypatch.setattr(shares, "SHARE_ROWS", share)
    dice, prob = random.Random(5), {}
    states = ["hub", None, *[f"s{i}" for i in range(40)]]
    for key in ("x", None):
        for s in states:
            ends = ["hub", *dice.sample(states[1:], 3)]
            left = [dice.random() for _ in ends]
            prob |= {(key, s, e): p / sum(left) for e, p in zip(ends, left)}
    cells = spark.createDataFrame([(*k, p) for k, p in prob.items()], "scenario string, from_state string, to_state string, prob double")
    matrix = sparse_markov.coordinate_matrix(cells, "scenario")
    assert matrix.where("from_block > 0").select("to_state").distinct().collect() == [("hub",)]
    parts = {(r.scenario, r.from_state, r.to_state): r.parts for r in matrix.collect()}
    vector = {(k, s): dice.choice((10**18, dice.randrange(10**18))) for k in ("x", None) for s in states}
    rows = spark.createDataFrame([(*k, p) for k, p in vector.items()], "scenario string, state string, parts long")
    short = sparse_markov._times(rows, matrix, ["scenario"], "to_state", "from_state").collect()
    monkeypatch.setattr(sparse_markov, "SENT_ROWS", 0)
    known = {}
    step = sparse_markov._times(rows, matrix, ["scenario"], "to_state", "from_state", known=known)
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert ("ShuffledHashJoin [_left" if share else "SortMergeJoin [_left") in plan and "isnull(" not in plan.split("Join [")[1].split("]")[0]
    # Copies of the hub only, in both scenarios.
    assert len(known["many"]) == 2 and known["size"] == len(parts)
    want = {}
    for (key, s, e), p in parts.items():
        want[key, s] = want.get((key, s), 0) + p * vector[key, e]
    want = {k: v // 10**18 for k, v in want.items() if v >= 10**18}
    assert {(r.scenario, r.state): r.parts for r in step.collect()} == want == {(r.scenario, r.state): r.parts for r in short}
    starts = matrix.select("scenario", F.col("from_state").alias("previous"), F.col("to_state").alias("state"), "parts")
    ahead = sparse_markov._times(starts, matrix, ["scenario"], "from_state", "to_state", ["previous"])
    assert "SortMergeJoin [_left" in ahead._jdf.queryExecution().executedPlan().toString()
    twice = {}
    for (key, a, b), p in parts.items():
        for (other, c, d), q in parts.items():
            if (key, b) == (other, c):
                twice[key, a, d] = twice.get((key, a, d), 0) + p * q
    assert {(r.scenario, r.previous, r.state): r.parts for r in ahead.collect()} == {k: v // 10**18 for k, v in twice.items() if v >= 10**18}


def test_a_log_is_worked_out_once(spark, monkeypatch):
    """Moves of a joined log ask nothing of it before it is written; empty logs are refused as before."""
    schema, asked = "who int, at string, state string, tie int", []
    frame = type(spark.range(1))
    empty = frame.isEmpty
    monkeypatch.setattr(frame, "isEmpty", lambda self: asked.append(1) or empty(self))
    log = spark.createDataFrame([(1, "2020-01-01", "A", 1), (1, "2020-01-02", "B", 2)], schema)
    moves = summaries.estimate_transitions(log, "who", "at", "state", "tie", whole=False).collect()
    assert [tuple(r) for r in moves] == [("A", "B", 1, 1.0)] and not asked
    with pytest.raises(InputProblem, match="readable date"):
        summaries.estimate_transitions(log.withColumn("at", F.lit("soon")), "who", "at", "state", "tie")
    nameless = log.withColumn("state", F.lit(None).cast("string"))
    assert summaries.estimate_transitions(nameless, "who", "at", "state", "tie", whole=False).count() == 0
