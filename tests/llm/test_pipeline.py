"""The pipeline's stages one after another, each against a plain computation on what the one before it kept."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from patronage.errors import InputProblem  # noqa: E402
from patronage.llm import (byte_bpe, decontamination, lengths, near_dedup, quality_rules, queries,  # noqa: E402
                           substring_dedup)

FOLDER = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_run(spark):
    tiktoken = pytest.importorskip("tiktoken")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, texts(docs)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        out[name] = texts(docs) if "text" in docs.columns else docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    judged = {r.doc_id: r.kept for r in quality_rules.judged(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    good = {i: t for i, t in before.items() if judged[i]}
    assert out["quality rules"] == good and 0.7 * len(before) < len(good) < len(before)
    root = brute.components(list(good.items()))
    single = {i: t for i, t in good.items() if root[i] == i}
    assert out["near-duplicates"] == single and len(single) < len(good)
    cut = brute.kept_words(list(single.items()))
    left = {i: (single[i] if n == len(w) else " ".join(w)) for i, (n, w) in cut.items() if w}
    assert out["repeated passages"] == left
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {i for i, *_ in brute.leaks(list(left.items()), items)}
    clean = {i: t for i, t in left.items() if i not in dirty}
    assert out["decontamination"] == clean and dirty
    reference = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS),
                                  special_tokens={})
    assert {r.doc_id: list(r.token_ids) for r in out["byte-level BPE"]} \
        == {i: reference.encode_ordinary(t) for i, t in clean.items()}
    again = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, again.collect())) == sorted(map(str, out["byte-level BPE"]))


def test_stages_on_awkward_rows(spark):
    """Nulls, empty and repeated rows and extra columns go through every stage; an empty table stays empty."""
    long = " ".join("the word%d of a" % k for k in range(40))
    rows = [(1, long, "en", "a", 5), (1, long, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0),
            (None, long, "en", "c", 1), (4, long.replace("word7", "other"), "en", "d", 2), (5, "too short", "en", "e", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"id": F.lit(1), "b": F.lit("x")})
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, FOLDER), stage(spark, empty, FOLDER)
        assert empty.count() == 0
    # Rows without an id are judged like others, but are linked with nothing.
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, None]


def test_rows_are_judged_by_themselves(spark):
    """Shared and missing ids, ids that are texts, and columns named like those the stages add."""
    good = {k: " ".join("the %s%d of a" % (k, n) for n in range(40)) for k in "uvw"}
    bad = "a " * 200
    rows = [("1", good["u"]), ("1", bad), (None, good["v"]), ("2", good["w"]), ("1", good["w"] + " end"), ("1", good["u"]),
            ("3", None), ("3", None), ("4", good["v"])]
    extra = {c: F.lit("x") for c in ("_kept_id", "_leak_id", "_row", "_ids", "_sha", "_words", "_cut", "text_id", "row", "c0",
                                     "component", "blank", "kept", "key")}
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows],
                                 "doc_id string, text string, lang string, source string, n_chars long").withColumns(extra)

    def found(df):
        assert df.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    assert found(quality_rules.without_rejected(docs)) == sorted([x for x in rows if x[1] not in (bad, None)], key=str)
    assert found(near_dedup.without_near_duplicates(docs)) == sorted(
        [("1", good["u"]), ("1", bad), (None, good["v"]), ("1", good["w"] + " end"), ("3", None), ("4", good["v"])], key=str)
    item = spark.createDataFrame([(1, " ".join(good["u"].split()[:30]))], "item_id long, text string")
    assert found(decontamination.without_leaks(docs, item)) == sorted([x for x in rows if x[1] != good["u"]], key=str)
    counted = lengths.token_counts(docs, queries.RANKS, queries.PATTERN)
    assert set(counted.columns) == set(docs.columns) - {"text"} | {"n_tokens"} and counted.first()["_ids"] == "x"
    whole = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        whole = stage(spark, whole, FOLDER)
        assert whole.columns == docs.columns
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in corpus_pipeline.encode(spark, whole, FOLDER).collect()) \
        == [(0, True), (1, True), (1, True), (4, True)]
    for call in (near_dedup.near_duplicates, substring_dedup.without_repeats):
        with pytest.raises(InputProblem):
            call(docs)
    with pytest.raises(InputProblem):
        decontamination.leaks(docs, item)
