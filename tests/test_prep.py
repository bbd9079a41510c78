"""Columns by role, profiles, safe cells, files, medians."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from patronage import columns, scratch
from patronage.errors import InputProblem
from patronage.operators import medians, prep, targeting
from patronage.sources import readers, sinks


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1",), ("x",), (" 3.5 ",), ("1d",), ("0x1p3",), ("NaN",), ("1e2",), ("inf",), (None,)],
                               "a string")
    got = [r["a"] for r in prep.coerce_numeric(df, "a").collect()]
    assert got == [1.0, None, 3.5, None, None, None, 100.0, float("inf"), None]
    text = spark.createDataFrame([("EUR 7.5",), ("8 pcs",)], "price string")
    with pytest.raises(InputProblem, match="EUR 7.5"):
        prep.coerce_numeric(text, "price", "unit price")
    few = spark.createDataFrame([(k,) for k in range(8)], "a int")
    with pytest.raises(InputProblem, match="at least 9"):
        prep.coerce_numeric(few, "a", "step", 9)
    with pytest.raises(InputProblem, match="Not in the table"):
        prep.coerce_numeric(few, "b")


def test_dates_from_text(spark):
    cells = {
        "1999-12-05": "1999-12-05 00:00:00", "5.12.1999": "1999-12-05 00:00:00", "1999-12-05 07:45": "1999-12-05 07:45:00",
        "12/5/1999": "1999-12-05 00:00:00", "1999/12/5 7:45:01": "1999-12-05 07:45:01", "19991205": "1999-12-05 00:00:00",
        "1999-12-05T07:45:01.250": "1999-12-05 07:45:01.250000", "1999-12-05T07:45:01Z": "1999-12-05 07:45:01",
        "1999-12-05T07:45:01+03:00": "1999-12-05 07:45:01", "19991205T074501": "1999-12-05 07:45:01",
        "\t1999-12-05\n": "1999-12-05 00:00:00", "\u00a01999-12-5 ": "1999-12-05 00:00:00", "05.12.1999 7:45": "1999-12-05 07:45:00",
        "1999": None, "soon": None, "1999-13-05": None, "": None}
    df = spark.createDataFrame([(c, "soon") for c in cells], "good string, bad string")
    got = [None if r["good"] is None else str(r["good"]) for r in prep.coerce_date(df, "good").collect()]
    assert dict(zip(cells, got)) == cells
    with pytest.raises(InputProblem, match="soon"):
        prep.coerce_date(df, "bad")
    day_first = prep.coerce_date(spark.createDataFrame([("03/04/2025",)], "d string"), "d", formats=["dd/MM/yyyy"])
    assert str(day_first.first()["d"]) == "2025-04-03 00:00:00"


def test_yes_and_no(spark):
    df = spark.createDataFrame([("yes", 1), (" No", 2), ("JA", 3), ("nei", 1), ("1", 1), ("0.0", 1), (None, 1)],
                               "resp string, score int")
    assert [r["resp"] for r in prep.coerce_binary(df, "resp").collect()] == [1, 0, 1, 0, 1, 0, None]
    with pytest.raises(InputProblem, match="2.0, 3.0"):
        prep.coerce_binary(df, "score")
    with pytest.raises(InputProblem, match="maybe"):
        prep.coerce_binary(spark.createDataFrame([("maybe",)], "resp string"), "resp")


def test_cells_with_white_space_around(spark):
    df = spark.createDataFrame([("\t12\n", "yes\n", "\r\nOrder "), ("\u00a03.5\u202f", "\tNO", None)],
                               "n string, a string, e string")
    assert [r["n"] for r in prep.coerce_numeric(df, "n").collect()] == [12.0, 3.5]
    assert [r["a"] for r in prep.coerce_binary(df, "a").collect()] == [1, 0]


def test_roles():
    columns.require_distinct_roles({"buyer": "c1", "day": "c2", "weight": None, "group": None})
    with pytest.raises(InputProblem, match="buyer and group"):
        columns.require_distinct_roles({"buyer": "c1", "day": "c2", "group": "c1"})


def test_profile(spark):
    rows = [(1, "b", float("nan"), True), (2, "a", 1.0, None), (3, None, 1.0, True)]
    df = spark.createDataFrame(rows, "id int, name string, v double, flag boolean")
    got = {r["column"]: r for r in prep.profile_table(df).collect()}
    assert (got["name"]["non_missing"], got["name"]["unique"], got["name"]["example"]) == (2, 2, "a")
    assert (got["v"]["non_missing"], got["v"]["unique"]) == (2, 1)
    assert got["v"]["missing_pct"] == pytest.approx(1 / 3)
    rough = {r["column"]: r["unique"] for r in prep.profile_table(df, approximate=True).collect()}
    assert rough == {"id": 3, "name": 2, "v": 1, "flag": 1}
    long = spark.createDataFrame([("y" * 500,)], "t string")
    assert len(prep.profile_table(long).first()["example"]) == 100
    empty = prep.profile_table(df.limit(0)).collect()
    assert all(r["non_missing"] == 0 and r["example"] == "" for r in empty)


def test_shape_and_preview(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a"), (1, None)], "a int, b string")
    assert tuple(prep.table_shape(df).first()) == (5, 2, 2)
    assert tuple(prep.table_shape(df.limit(0)).first()) == (0, 2, 0)
    assert prep.preview(spark.range(500), "id").count() == 100


def test_predictors(spark):
    rows = [(i, i % 2, i % 3, "x", f"t{i % 25}", f"u{i % 4}", float(i) if i % 9 else 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, answer int, few int, same string, many string, some string, num double")
    assert prep.usable_predictors(df, "answer") == ["few", "some", "num"]
    assert prep.usable_predictors(df, "answer", ids=["few"], limit=1) == ["some"]


def test_formulas_and_headers(spark):
    df = spark.createDataFrame([("=1+1", "a\x00b", 5), (" \t+x", "plain", -3), ("@y", "-z", 1), (None, "", 0)],
                               ["=cmd", "text", "n"])
    safe = prep.neutralize_formulas(df)
    assert safe.columns == ["'=cmd", "text", "n"]
    assert [tuple(r) for r in safe.collect()] == [("'=1+1", "ab", 5), ("' \t+x", "plain", -3), ("'@y", "'-z", 1), (None, "", 0)]
    assert prep.dedupe_headers(["a", " a ", "", "A", "a__2"]) == ["a", "a__2", "column_3", "A__3", "a__2__2"]
    twice = df.select("n", "n", F.col("text").alias("N"))
    assert prep.neutralize_formulas(twice).columns == ["n", "n__2", "N__3"]


def test_unreadable_rows(spark):
    df = spark.createDataFrame([("1", "2025-01-01", "yes"), ("x", "?", "no"), ("3", None, "2")], "a string, b string, c string")
    got = {r["column"]: (r["rows"], r["skipped"]) for r in
           prep.unreadable_rows(df, {"a": "number", "b": "date", "c": "binary"}).collect()}
    assert got == {"a": (3, 1), "b": (3, 2), "c": (3, 0)}
    with pytest.raises(InputProblem):
        prep.unreadable_rows(df, {"a": "colour"})


def test_json_tables(spark, tmp_path):
    payload = {"title": "demo", "year": 2025, "rows": [{"a": 1, "n": {"b": "x", "c": {"d": 2.5}}}, {"a": None}],
               "one": {"k": 1, "deep": {"z": [1, 2]}}, "plain": [3, 4]}
    path = tmp_path / "doc.json"
    path.write_bytes("﻿".encode() + json.dumps(payload).encode())
    tables = readers.read_json_tables(spark, str(path))
    assert set(tables) == {"summary", "rows", "one", "plain"}
    assert tables["summary"].first().asDict() == {"title": "demo", "year": 2025}
    assert sorted(tables["rows"].columns) == ["a", "n.b", "n.c.d"]
    assert [r["n.c.d"] for r in tables["rows"].collect()] == [2.5, None]
    assert tables["one"].first()["deep.z"] == [1, 2]
    assert [r[0] for r in tables["plain"].collect()] == [3, 4]
    records = tmp_path / "list.json"
    records.write_text(json.dumps([{"a": 1}, {"a": 2, "b": {"c": "t"}}]))
    only = readers.read_json_tables(spark, str(records))
    assert set(only) == {"data"} and sorted(only["data"].columns) == ["a", "b.c"] and only["data"].count() == 2
    bare = tmp_path / "bare.json"
    bare.write_text('"hello"')
    assert readers.read_json_tables(spark, str(bare))["data"].first()["value"] == "hello"


def test_json_out(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 1.5, "ø\"")], "a int, v double, t string")
    sinks.write_json_records({"x": df}, str(tmp_path / "lines"))
    lines = [json.loads(line) for f in sorted((tmp_path / "lines" / "x").glob("part-*.json"))
             for line in f.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["a"]) == [{"a": 1, "v": None, "t": None}, {"a": 2, "v": 1.5, "t": "ø\""}]
    sinks.json_document({"first": df, "se\"cond": df.limit(0)}, str(tmp_path / "doc"))
    text = next((tmp_path / "doc").glob("part-*")).read_text()
    whole = json.loads(text)
    assert whole["se\"cond"] == [] and sorted(r["a"] for r in whole["first"]) == [1, 2]
    long = spark.range(150_000, numPartitions=7).select("id", F.lit(float("nan")).alias("x"))
    sinks.json_document({"long": long, "none": long.limit(0), "few": long.limit(2)}, str(tmp_path / "big"))
    text, = [f.read_text() for f in (tmp_path / "big").glob("part-*")]
    whole = json.loads(text)
    assert [r["id"] for r in whole["long"]] == list(range(150_000)) and whole["long"][0]["x"] is None
    assert whole["none"] == [] and len(whole["few"]) == 2
    with pytest.raises(InputProblem):
        sinks.json_document({}, str(tmp_path / "empty"))


def test_csv_is_safe_by_default(spark, tmp_path):
    df = spark.createDataFrame([("=SUM(A1)", 1), ("a,\"b\"\nc", 2)], "t string, n int")
    sinks.write_table(df, str(tmp_path / "safe"), "csv")
    got = {r["n"]: r["t"] for r in readers.read_csv_table(
        spark, str(tmp_path / "safe"), "t string, n int", multiline=True).collect()}
    assert got == {1: "'=SUM(A1)", 2: "a,\"b\"\nc"}
    with pytest.raises(InputProblem):
        sinks.write_table(df, str(tmp_path / "x"), "xlsx")


@pytest.mark.parametrize("limit", [3, 50, 10_000])
def test_medians(spark, monkeypatch, limit):
    """The bracket narrows to the same middle values as a sort, also with heavy ties and even counts."""
    import random
    g = random.Random(limit)
    monkeypatch.setattr(medians, "HANDFUL", limit)
    monkeypatch.setattr(medians, "SLACK", 0.02)
    table = {"smooth": [g.gauss(0, 1) for _ in range(1000)], "odd": [g.uniform(0, 9) for _ in range(999)] + [None],
             "tied": [g.choice([1.0, 1.0, 2.0, 5.0]) for _ in range(1000)], "split": [1.0] * 500 + [2.0] * 500,
             "wild": [g.choice([-1, 1]) * 10 ** g.uniform(-200, 200) for _ in range(1000)], "none": [None] * 1000}
    df = spark.createDataFrame(list(zip(*table.values())), ", ".join(f"{c} double" for c in table)).repartition(5)
    got = medians.exact_medians(df, list(table))
    for c, v in table.items():
        known = [x for x in v if x is not None]
        assert got[c] == (pytest.approx(statistics.median(known)) if known else None)


def test_targeting_with_missing_scores(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.9), (None, 0.9), (1.0, None), (1.0, float("nan")), (1.0, 0.0625)],
                               "actual double, p double")
    out = targeting.targeting_profit(df, "actual", "p", 30.0, -2.0)
    assert [r["target"] for r in out.collect()] == [True, True, True, False, False, False]
    assert [r["realized_profit"] for r in out.collect()] == [30.0, -2.0, -2.0, 0.0, 0.0, 0.0]
    total = targeting.targeting_summary(out, "actual", 30.0, -2.0).first()
    assert (total["threshold"], total["customers_targeted"], total["responses_targeted"], total["realized_profit"]) \
        == (0.0625, 3.0, 1.0, 26.0)
    with pytest.raises(Exception, match="profit of a response"):
        targeting.targeting_profit(df, "actual", "p", -2.0, 1.0).collect()


def test_scratch_folder_is_the_clusters(spark):
    assert scratch.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_json_list_in_many_parts(spark, tmp_path):
    """Lists cut into parts of a few kilobytes: braces and quotes in texts, nested records, line breaks, odd files."""
    rows = [{"k": k, "text": ['}{"', "\\", '\\"}, {', "é}\n{", "", "]["][k % 6] * (k % 5),
             "inner": {"a": {"b": k, "c": [{"d": "}"}, {}]}}, "none": None} for k in range(3000)]
    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows[:2500], ensure_ascii=False), encoding="utf-8")
    (folder / "b.json").write_text("\ufeff" + json.dumps(rows[2500:2999], indent=2), encoding="utf-8")
    (folder / "c.json").write_text(json.dumps(rows[2999]))
    (folder / "d.json").write_text(" [ ]\n")
    (folder / "e.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        parts = readers.list_elements(spark, str(folder))
        got = [json.loads(r.value) for r in parts.collect()]
        table = readers.read_json_records(spark, str(folder), lines=False)
        assert table.rdd.getNumPartitions() > 1
        flat = {r["k"]: (r["text"], r["inner.a.b"], len(r["inner.a.c"])) for r in table.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=lambda r: r["k"]) == rows
    assert flat == {r["k"]: (r["text"], r["k"], 2) for r in rows}
    broken = tmp_path / "broken.json"
    broken.write_text('[{"k": 1}, {"k": {"m": 2')
    assert [r.value for r in readers.list_elements(spark, str(broken)).orderBy(F.length("value")).collect()] \
        == ['{"k": 1}', '{"k": {"m": 2']
    assert readers.read_json_records(spark, str(folder / "d.json"), "k long", lines=False).collect() == []
