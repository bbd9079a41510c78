"""A stream's totals after restarts, after crashes between any two steps, and after compactions."""

import pytest
from pyspark.sql import functions as F

from patronage.errors import InputProblem
from patronage.streaming import incremental

SCHEMA = "who int, at timestamp, paid double"


class Crash(Exception):
    pass


@pytest.fixture
def place(spark, tmp_path):
    """Purchases land in ``log``; ``run`` streams what is new; ``totals`` are count and money per customer."""
    log, out = str(tmp_path / "log"), str(tmp_path / "totals")

    class Place:
        path = out

        def land(self, *rows):
            spark.createDataFrame([(w, p) for w, p in rows], "who int, paid double").select(
                "who", F.lit("2024-01-01").cast("timestamp").alias("at"), "paid").coalesce(1).write.mode("append").parquet(log)

        def run(self, **options):
            stream = spark.readStream.schema(SCHEMA).parquet(log)
            incremental.stream_totals(stream, "who", "at", "paid", out, **options).awaitTermination()

        def totals(self):
            rows = incremental.current_totals(incremental.read_updates(spark, out), "who").collect()
            return {r["who"]: tuple(v for v in r.asDict().values() if isinstance(v, (int, float)))[1:] for r in rows}

    return Place()


def paid(place):
    return {who: max(values) for who, values in place.totals().items()}


def test_a_restart_without_a_checkpoint_goes_on(place):
    for amount in (10.0, 7.0, 100.0):
        place.land((1, amount), (2, 1.0))
        place.run()
    assert paid(place) == {1: 117.0, 2: 3.0}


@pytest.mark.parametrize("step", ["before the switch", "after the switch"])
def test_a_crash_within_a_batch(place, monkeypatch, step):
    place.land((1, 10.0))
    place.run()
    place.land((1, 5.0), (3, 2.0))
    switch = incremental._switch

    def crash(*args, **changes):
        if step == "after the switch":
            switch(*args, **changes)
        raise Crash

    monkeypatch.setattr(incremental, "_switch", crash)
    with pytest.raises(Exception, match="Crash"):
        place.run()
    assert paid(place) == ({1: 10.0} if step == "before the switch" else {1: 15.0, 3: 2.0})
    monkeypatch.undo()
    place.run()
    place.land((3, 1.0))
    place.run()
    assert paid(place) == {1: 15.0, 3: 3.0}


@pytest.mark.parametrize("step", ["_switch", "_sweep", None])
def test_a_crash_within_a_compaction(spark, place, monkeypatch, step):
    for amount in (10.0, 7.0):
        place.land((1, amount), (2, 1.0))
        place.run()
    before = place.totals()

    def crash(*args, **changes):
        raise Crash

    if step:
        monkeypatch.setattr(incremental, step, crash)
        with pytest.raises(Crash):
            incremental.compact_totals(spark, place.path, "who")
        monkeypatch.undo()
        assert place.totals() == before
    incremental.compact_totals(spark, place.path, "who")
    assert place.totals() == before
    files = incremental._Files(spark, place.path)
    assert len(incremental._manifest(files)["folders"]) == 1 and files.names("data") == ["batch=1"]
    assert len(files.names("data/batch=1")) == 1
    place.land((2, 4.0))
    place.run()
    assert paid(place) == {1: 17.0, 2: 6.0}


def test_a_manifest_that_broke_off_does_not_count(spark, place):
    place.land((1, 10.0))
    place.run()
    incremental._Files(spark, place.path).create("manifest/9", '{"version": 9, "fol')
    assert paid(place) == {1: 10.0}
    place.land((1, 1.0))
    place.run()
    assert paid(place) == {1: 11.0} and "10" in incremental._Files(spark, place.path).names("manifest")


def test_another_stream_is_refused(spark, place, tmp_path):
    place.land((1, 10.0))
    place.run()
    place.land((1, 1.0))
    with pytest.raises(Exception, match="another stream"):
        place.run(checkpoint=str(tmp_path / "other"))
    with pytest.raises(InputProblem):
        incremental.read_updates(spark, str(tmp_path / "nothing"))
