"""Each operator against a plain computation, over a given table and over a table of awkward rows."""

import collections
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

queries = pytest.importorskip("patronage.llm.queries")

from patronage import scratch  # noqa: E402
from patronage.errors import InputProblem  # noqa: E402
from patronage.llm import (byte_bpe, decontamination, language_id, lengths, near_dedup, packing, perplexity,  # noqa: E402
                           quality_rules, substring_dedup, toxicity)

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, id string, version int, bucket long, a double, c0 int, label int"


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(400)] + ["Über", "naïve", "日本", "it's", "x,", "THE"]

    def text(n, sep=" "):
        return sep.join(rng.choice(vocabulary) for _ in range(n))

    passage, template = text(60), text(120).split(" ")
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, "one two"), (5, "ONE two"), (6, "a " * 300),
            (7, text(3000)), (8, text(30) + " " + passage), (9, passage + "\n" + text(25)), (10, text(500, "\n")),
            (11, "same line here\n" * 12), (12, "\x1fword\x00 \v\f\r end"), (13, "x" * 5000), (14, "===" * 400 + "  \n\n x")]
    for k in range(20, 60):  # near copies of one text, some closer than others
        own = list(template)
        for _ in range(k % 7):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((k, " ".join(own)))
    rows += [(70, rows[8][1]), (70, rows[8][1]), (71, passage), (72, text(19)), (73, text(20)), (74, text(21))]
    return rows


def table(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, lang, "x", 1, None, 0.5, 3, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return awkward_rows(), table(spark, awkward_rows())


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.collect()], docs


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_quality_counts(request, which):
    rows, docs = request.getfixturevalue(which)
    found = quality_rules.judged(docs).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                              for r in found)
    assert got == collections.Counter((i, *brute.base_counts(t)) for i, t in rows)
    assert not any(r.kept for r in found if r.base_failed)


def test_quality_distances(spark):
    """Two languages of fixed words: a text of the other's alphabet and unknown words is far from both."""
    en = " ".join(["the cat and the dog of a house"] * 1)
    rows = [(k, f"{en} {'abcdefgh'[k % 8] * 3} is in the garden of the king and the queen number {k} " * 2 + f"end{k} of it all")
            for k in range(40)]
    odd = (100, " ".join(f"@{k}@%%{k * 7919}##" for k in range(120)))
    found = {r.doc_id: r for r in quality_rules.judged(table(spark, rows + [odd])).collect()}
    assert found[100].char_distance > quality_rules.FAR_CHARS and not found[100].kept and not found[100].base_failed
    assert found[0].nearest_lang == "en" and found[0].word_distance < quality_rules.FAR_WORDS


def test_quality_of_unknown_words(spark):
    """Long prose-shaped texts of unknown words go, whichever languages are in the table; texts of the languages stay."""
    rng = random.Random(12)
    common = {"en": ["the", "of", "and", "to", "in", "is", "that", "it"], "fr": ["le", "de", "et", "la", "les", "un", "est", "que"]}

    def made(stem):
        return "".join(rng.choice(stem) for _ in range(rng.randrange(4, 9)))

    def prose(lang, n):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.32 else made("abcdefghij") for _ in range(n)) + "."

    rows = [(k, prose("en" if k % 2 else "fr", 40 + 10 * k), "en" if k % 2 else "fr") for k in range(60)]
    flat = [(100 + k, " ".join(made("klmnopqrst") for _ in range(300)), "flat") for k in range(40)]
    odd = [(200 + k, " ".join(made("uvwxyzabcd") for _ in range(n)), lang)
           for k, (n, lang) in enumerate([(50, "en"), (400, "en"), (400, None), (5000, "fr")])]
    frame = spark.createDataFrame(rows + flat + odd, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality_rules.judged(frame).collect()}
    assert not any(r.base_failed for r in found.values())
    assert not any(found[200 + k].kept for k in range(4))
    assert all(found[i].kept for i, *_ in rows) and all(found[i].kept for i, *_ in flat)


def test_quality_without_languages(spark, awkward, nothing):
    found = quality_rules.judged(awkward[1].withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r.kept != r.base_failed and r.word_distance is None for r in found)
    assert quality_rules.judged(nothing).collect() == []


def test_distance_is_that_of_jensen_and_shannon():
    import numpy as np
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), np.array([0.5, 0.5, 0.0])
    assert quality_rules.distance(p, q)[0] == 0
    assert quality_rules.distance(p, q)[2] == pytest.approx(1)
    assert quality_rules.distance(p, q)[1] == pytest.approx((0.5 * np.log2(4 / 3) + 0.25 * np.log2(2 / 3) + 0.25) ** 0.5)


def test_language_accuracy_and_edges(spark, given, nothing):
    found = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in found if r.held_out]
    assert len(test) > 100 and sum(r.lang == r.lang_pred for r in test) >= 0.97 * len(test)
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 34 .", "en"), (3, "the house of the", "en"), (4, "the", None),
                                  (None, "der und die", "de"), (3, "the house of the", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predicted(docs, docs).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0
    assert got[3].lang_pred == got[4].lang_pred == "en" and got[None].lang_pred == "de"
    assert {r.lang_pred for r in language_id.predicted(docs, nothing).collect()} == {"und"}
    assert language_id.predicted(nothing, docs).collect() == []


def test_language_code_length_by_hand(spark):
    """PPM over 'ab' in 'aaab': probabilities and escapes worked out from the counts."""
    import numpy as np
    docs = spark.createDataFrame([("en", "aaab")], "lang string, text string")
    trees = language_id.Trees(language_id.trained(docs))
    data = np.frombuffer(b"a", np.uint8)
    # The only byte ever seen after the start of a text is 'a': one symbol, once: 1 / (1 + 1).
    assert trees.code_lengths(data, np.array([0, 1]))[0, 0] == pytest.approx(1)
    # 'c' was never seen: escapes from the start, twice and thrice alike, then from all bytes (4 symbols, 2 different).
    escapes = 1 + 1 + 1 + np.log2(6 / 2)
    assert trees.code_lengths(np.frombuffer(b"c", np.uint8), np.array([0, 1]))[0, 0] == pytest.approx(escapes + 8)


def test_toxicity(spark, nothing):
    rng = random.Random(3)
    plain, bad = ["word%d" % k for k in range(300)], ["vile", "nasty", "grossly"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (1002, "nasty vile"), (None, "grossly vile " * 3), (1002, "nasty vile")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    part = toxicity.fold(F.col("id"))
    found = toxicity.scored(frame, marks, part.isin(0, 1), part == 3).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    unseen = {r.doc_id for r in frame.where(toxicity.fold(F.col("doc_id")) == 2).collect()}
    truth = dict(labels)
    right = [(r.score >= 0.3) == bool(truth[r.doc_id]) for r in found if r.doc_id in unseen and r.doc_id in truth]
    assert len(right) > 80 and sum(right) >= 0.97 * len(right)
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[1002] > 0.9 and by_id[None] > 0.9 and by_id[1000] == by_id[1001] < 0.3
    alone = toxicity.scored(frame, marks.where("toxic = 1"), part.isin(0, 1), part == 3).collect()
    assert len({r.score for r in alone}) == 1
    assert toxicity.scored(frame, marks.where("false"), part.isin(0, 1), part == 3).first().score == 0
    assert toxicity.scored(nothing, marks, part.isin(0, 1), part == 3).collect() == []


def test_toxicity_keeps_every_pair_with_evidence(spark, monkeypatch):
    """A toxic expression of two ordinary words, rarer than ordinary pairs, whatever number of pairs is sent to all tasks."""
    import numpy as np
    monkeypatch.setattr(toxicity, "HEAD_PAIRS", 20)
    rng = random.Random(6)
    plain = ["word%d" % k for k in range(12)]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(100)] + ["alpha", rng.choice(plain), "beta"]
        if i < 50:
            w += ["alpha", "beta"]
        rows.append((" ".join(w), int(i < 50)))
    model = toxicity.trained(spark.createDataFrame(rows, "text string, toxic int"))
    hashes = toxicity.Hasher(toxicity.BASES[0])
    (*_, found), = toxicity._tokens(toxicity.pa.array(["alpha beta"]), toxicity.separators(), toxicity.lower_table(), hashes)
    key = int(toxicity.pair_hash(found[:1], found[1:]).view(np.int64)[0])
    pairs = {r["key"]: r["evidence"] for r in model.pairs.collect()}
    assert pairs[key] > 1 and np.isfinite(list(pairs.values())).all()


def toxic_texts() -> list[tuple[str, int]]:
    rng = random.Random(21)
    plain = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(4000)]
    rows = []
    for i in range(120):
        w = [rng.choice(plain) for _ in range(rng.randrange(0, 40))]
        rows.append((", ".join(w + ["Vile", "thing"] * (i % 4 == 0) * 2), int(i % 4 == 0)))
    return rows + [(None, 0), ("", 1), ("w1", 1), rows[0], rows[0]]


def test_toxicity_models_add_up():
    """The plain models the operator is compared with are distributions after every context, seen or not."""
    model = brute.ToxicModels(toxic_texts())
    for c in (0, 1):
        for before in [*list(model.words)[:20], None, "never seen"]:
            total = sum(model.probability(c, before, w) for w in model.words) + model.probability(c, before, "never seen")
            assert total == pytest.approx(1)


@pytest.mark.parametrize("heads", [(1 << 18, 1 << 20), (40, 60), (0, 0)])
def test_toxicity_likelihoods_by_brute_force(spark, monkeypatch, heads):
    """Log-likelihoods per word and the strongest words by plain Python, however much of the models is sent to all tasks."""
    import math
    monkeypatch.setattr(toxicity, "HEAD_WORDS", heads[0])
    monkeypatch.setattr(toxicity, "HEAD_PAIRS", heads[1])
    rows = toxic_texts()
    plain = brute.ToxicModels(rows)
    model = toxicity.trained(spark.createDataFrame(rows, "text string, toxic int"))
    texts = [t for t, _ in rows] + ["unknown words, vile unknown w1 w2 vile vile", "w1", "thing vile", "w1 " * 30000 + "vile", " .,! "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r["id"]: r for r in toxicity.evidence(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = brute.toxic_words(text)
        if not words:
            assert got[i]["mean"] is None and got[i]["best"] == got[i]["second"] == 0
            continue
        ratio = sum(math.log(plain.probability(1, b, w) / plain.probability(0, b, w)) for b, w in zip([None, *words], words))
        assert got[i]["mean"] + got[i]["rest"] == pytest.approx(ratio / len(words), abs=1e-9)
        strongest = sorted([0, 0, *[plain.evidence(w) for w in words]])[-2:]
        assert [got[i]["second"], got[i]["best"]] == pytest.approx(strongest, abs=1e-9)


def test_toxicity_counts_what_it_does_not_calibrate_on(spark, monkeypatch):
    """Words of abuse that only texts beyond the calibration sample hold are learned."""
    monkeypatch.setattr(toxicity, "CALIBRATION", 60)
    rng = random.Random(14)
    plain = ["word%d" % k for k in range(100)]
    counted = []
    train = toxicity.trained
    monkeypatch.setattr(toxicity, "trained", lambda rows: counted.append(rows.count()) or train(rows))
    docs = [(i, " ".join(rng.choice(plain) for _ in range(50)) + (" vile" * 3 if i % 4 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    part = toxicity.fold(F.col("id"))
    found = toxicity.scored(frame, marks, part.isin(0, 1), part == 3).count()
    of = collections.Counter(r.f for r in frame.select(toxicity.fold(F.col("doc_id")).alias("f")).collect())
    assert found == 400 and of[3] > 60 and counted == [of[0] + of[1] + of[3] - 60]


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_toxicity_gives_its_shuffle_files_back(spark):
    """A finished step's files do not wait for the driver to collect its plan, and the session's setting stays its own."""
    frame = spark.createDataFrame([(i, f"{t} {i % 3}") for i, (t, _) in enumerate(toxic_texts() * 10)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(toxic_texts() * 10)], "doc_id long, toxic int")
    part = toxicity.fold(F.col("id"))
    before, own = shuffle_files(spark), spark.conf.get(scratch.TIDY, None)
    found = toxicity.scored(frame, marks, part.isin(0, 1), part == 3)
    assert shuffle_files(spark) <= before
    assert spark.conf.get(scratch.TIDY, None) == own
    assert found.count() == found.count() == frame.count()


@pytest.mark.parametrize("passes", [1, 3])
def test_toxicity_in_any_number_of_passes(spark, monkeypatch, passes):
    for name, value in (("PASSES", passes), ("HEAD_WORDS", 1), ("HEAD_PAIRS", 1)):
        monkeypatch.setattr(toxicity, name, value)
    rows = toxic_texts()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, text string")

    def found():
        model = toxicity.trained(spark.createDataFrame(rows, "text string, toxic int"))
        return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in toxicity.evidence(docs, model).orderBy("id").collect()]

    parted = found()
    for name, value in (("PASSES", 1), ("HEAD_WORDS", 1 << 18), ("HEAD_PAIRS", 1 << 21)):
        monkeypatch.setattr(toxicity, name, value)
    assert parted == found() and len(parted) == len(rows)


def test_toxicity_on_held_out_rows(spark):
    """Documents in English with words of abuse are found in the fold that was not learned from."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op3_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in found if r.toxic == 1]
    clean = [r for r in found if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.06 * len(clean)


def test_perplexity(spark, nothing):
    rng = random.Random(8)
    common = ["the", "of", "and", "house", "garden", "king"] * 8 + ["n%d" % k for k in range(30)]
    good = [(i, " ".join(rng.choice(common) for _ in range(60)), "en") for i in range(300)]
    docs = good + [(900, " ".join("zq%d" % (k * 977) for k in range(60)), "en"), (901, None, "en"), (902, " ", None),
                   (903, "the house", "en"), (904, good[0][1], "xx"), (None, good[0][1], "en"), (0, good[0][1], "en")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(900, 0), (3, 0), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in perplexity.judged(frame, labels).collect()}
    assert perplexity.judged(frame, labels).count() == len(docs)
    assert not found[900].kept and found[900].perplexity > 5 * found[900].threshold
    assert sum(found[i].kept for i in range(300)) >= 295
    assert found[901].perplexity is None and not found[901].kept and not found[902].kept and found[903].kept
    assert found[904].kept and found[904].perplexity == found[0].perplexity and found[None].kept
    untrained = perplexity.judged(frame, labels.where("false")).collect()
    assert all(r.perplexity is None and r.kept == (r.n_words > 0) for r in untrained)
    assert perplexity.judged(nothing, labels).collect() == []


def test_perplexity_model_adds_up(spark):
    """After any context the probabilities of all words, and of one never seen, sum to one."""
    rng = random.Random(1)
    texts = spark.createDataFrame([(" ".join(rng.choice("abcdef") for _ in range(200)),) for _ in range(20)], "text string")
    openings = ["", "c", "a b", "f f", "d never"]
    rows = [(k, w, " ".join([*opening.split(), w]).strip()) for k, opening in enumerate(openings) for w in ["", *"abcdef", "new"]]
    docs = spark.createDataFrame(rows, "k int, w string, text string")
    bits = {(r.k, r.w): (r.mean_bits or 0) * r.n_words
            for r in perplexity.perplexities(docs, perplexity.counted_model(texts), ["k", "w"]).collect()}
    for k in range(len(openings)):
        assert sum(2 ** (bits[k, ""] - bits[k, w]) for w in [*"abcdef", "new"]) == pytest.approx(1), openings[k]


def test_perplexity_gives_its_disk_back(spark, monkeypatch):
    """Only the results stay stored, and they do not depend on the numbers of parts."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join("w%d" % min(rng.randrange(400), rng.randrange(400)) for _ in range(50)), "en")
                                  for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")

    def tables():
        folder = scratch.scratch_folder(spark).split("://")[-1]
        return {os.path.relpath(path, folder).split("/")[0] for path, _, files in os.walk(folder)
                if any(f.endswith(".parquet") for f in files)}

    earlier, found = tables(), []
    for parts in ((1, 1, 1), (2, 2, 2)):
        for name, n in zip(("PASSES", "PARTS", "RANGES"), parts):
            monkeypatch.setattr(perplexity, name, n, raising=False)
        found.append(sorted(perplexity.judged(docs, labels).collect()))
    assert {name.rsplit("-", 1)[0] for name in tables() - earlier} == {"perplexities"}
    assert found[0] == found[1] and len(found[0]) == 60


def test_perplexity_packs_keys_and_numbers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) if n else np.zeros(0, np.uint64))
        assert (perplexity._keys_in(perplexity._packed(keys)) == keys).all()
        columns = [np.arange(len(keys)), np.full(len(keys), 1 << 40), np.zeros(len(keys), np.int64)]
        assert all((x == y).all() for x, y in zip(perplexity._columns_in(perplexity._numbers(*columns), len(keys)), columns))
    ends = np.array([0, (1 << 64) - 1], np.uint64)
    for shards in (12, 36, 1 << 16):
        assert perplexity._shard(ends, shards).tolist() == [0, shards - 1]
        keys = rng.integers(0, 1 << 64, 1000, np.uint64, endpoint=False)
        own = perplexity._shard(keys, shards)
        assert (perplexity._inside(keys, shards, 3, shards // 2) == ((own >= 3) & (own < shards // 2))).all()
        assert perplexity._inside(keys, shards, 0, shards).all()


def test_perplexity_knows_every_word_and_trigram(spark):
    """Against a plain modified Kneser-Ney model of all words and n-grams, those seen once included."""
    import math
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(9000)]  # more than any fixed number of words of the bounded model
    rows = [(i, " ".join(rng.choice(vocabulary[:60] if rng.random() < 0.6 else vocabulary) for _ in range(80))) for i in range(400)]
    rows += [(1000, rows[0][1] + " never seen"), (1001, ""), (1002, "w1")]
    docs = spark.createDataFrame(rows, "id long, text string")
    train = [t.split() for i, t in rows[:300]]
    model = perplexity.counted_model(docs.where("id < 300"))
    found = {r.id: r for r in perplexity.perplexities(docs, model, ["id"]).collect()}
    three = collections.Counter(g for t in train for g in zip(["<", "<"] + t, ["<"] + t, t))
    two = collections.Counter(g[1:] for g in three)
    one = collections.Counter(g[1:] for g in two)

    def discounts(counts):
        n1, n2, n3, n4 = (sum(n == k for n in counts.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [min(max(x, 0.1), k - 0.1) for x, k in zip(d, (1, 2, 3))]

    levels = []
    for counts in (one, two, three):
        d, total, left = discounts(counts), collections.Counter(), collections.Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        levels.append((counts, d, total, left))

    def probability(gram):
        p = 1 / (len(one) + 1)
        for k, (counts, d, total, left) in enumerate(levels):
            g = gram[2 - k:]
            if total[g[:-1]]:
                n = counts[g]
                p = ((n - d[min(n, 3) - 1] if n else 0) + left[g[:-1]] * p) / total[g[:-1]]
        return p

    assert len(found) == len(rows) and found[1001].mean_bits is None
    for i, text in rows:
        t = text.split()
        if t:
            bits = [-math.log2(probability(g)) for g in zip(["<", "<"] + t, ["<"] + t, t)]
            assert found[i].n_words == len(t) and found[i].mean_bits == pytest.approx(sum(bits) / len(t), abs=2e-6)


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_repeated_passages(request, which):
    rows, docs = request.getfixturevalue(which)
    cut = substring_dedup.without_repeats(docs, counts=("n_words", "n_removed"))
    assert cut.columns == [*docs.columns, "n_words", "n_removed"]
    expected = brute.kept_words(list(dict.fromkeys(rows)))
    found = cut.collect()
    assert len(found) == len(rows)
    for r in found:
        n, left = expected[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(left)), r.doc_id
        assert brute.words(r.text) == left and (r.n_removed or r.text == dict(rows)[r.doc_id])


def test_repeated_passages_short_windows_and_no_ids(spark, nothing):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(30)]
        cut = substring_dedup.without_repeats(table(spark, rows), length=7).collect()
        expected = brute.kept_words(rows, 7)
        assert all(brute.words(r.text) == expected[r.doc_id][1] for r in cut)
    text = " ".join("w%d" % k for k in range(50))
    loose = spark.createDataFrame([(None, text), (1, text), (None, text), (2, text + " more"), (2, "other")],
                                  "doc_id long, text string")
    got = substring_dedup.without_repeats(loose, counts=("n", "cut")).collect()
    assert sorted((r.doc_id or 0, r.n, r.cut) for r in got) == [(0, 50, 0), (0, 50, 0), (1, 50, 0), (2, 1, 0), (2, 51, 50)]
    assert substring_dedup.without_repeats(nothing).collect() == []


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_near_duplicates(request, which):
    rows, docs = request.getfixturevalue(which)
    expected = brute.components(rows)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id), r.doc_id
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_near_duplicates_in_blocks(spark, monkeypatch, nothing):
    """Loose copies of several texts, with blocks and salts so small that every bucket is split."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SALT_ROWS", 2)
    rng = random.Random(9)
    rows = []
    for group in range(3):
        base = ["g%dw%d" % (group, rng.randrange(500)) for _ in range(150)]
        for k in range(40):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = "z%d" % rng.randrange(10_000)
            rows.append((len(rows), " ".join(own)))
    expected = brute.components(rows)
    assert 3 < len(set(expected.values())) < 100
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()} == expected
    loose = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(loose).orderBy("doc_id", "n_shingles").collect()] \
        == [(None, None, True), (None, None, True), (1, 1, True)]
    assert near_dedup.without_near_duplicates(loose).count() == 3
    assert near_dedup.near_duplicates(nothing).collect() == []


def test_parity_never_rejects_a_link():
    import numpy as np
    rng = np.random.default_rng(4)
    for n in (3, 40, 130, 700):
        for _ in range(40):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            extra = [rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 6), dtype=np.uint64) for _ in range(2)]
            sets = [np.unique(np.concatenate([both, x])) for x in extra]
            full = [np.frombuffer(near_dedup.parity(s), np.uint64) for s in sets]
            size = np.array([len(s) for s in sets])
            linked = 100 * len(np.intersect1d(*sets)) >= 75 * len(np.union1d(*sets))
            said = near_dedup.possible(full, np.array([len(x) for x in full]), size, np.array([0]), np.array([1]), 75)[0]
            assert said or not linked


def test_leaks(spark, given, nothing):
    rows, docs = given
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    found = decontamination.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in found} == brute.leaks(rows, texts)
    left = decontamination.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == len(rows) - len({r.doc_id for r in found})


def test_leaks_of_short_items(spark):
    """Items of 1 to 12 words inside long texts, whole or with one word changed at an end."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(k, " ".join(word() for _ in range(1 + k % 12))) for k in range(600)]
    docs = []
    for k, text in items:
        own, around = text.split(), [word() for _ in range(400)]
        if k % 5 == 0:
            own[-1] = "CHANGED"
        at = rng.randrange(400)
        docs.append((k, " ".join(around[:at] + own + around[at:])))

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}

    expected = set()
    for (k, item), (_, text) in zip(items, docs):
        of_item = shingles(item)
        both = len(of_item & shingles(text))
        if 100 * both >= 75 * len(of_item):
            expected.add((k, k, len(of_item), both))
    assert {n for *_, n, _ in expected} == set(range(1, 9))
    found = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(r) for r in found} == expected


def test_leaks_scattered_and_awkward(spark, awkward, nothing):
    rng = random.Random(12)
    item = ["q%d" % k for k in range(40)]
    filler = lambda n: " ".join("f%d" % rng.randrange(10_000) for _ in range(n))
    rows = [(1, filler(4000) + " " + " ".join(item) + " " + filler(4000)),
            (2, " ".join(item[:20]) + " " + filler(3000) + " " + " ".join(item[16:])),  # all shingles, far apart
            (3, filler(300) + " " + " ".join(item[:25])), (4, None), (5, "Short One"), (6, filler(200)),
            (None, " ".join(item))]
    items = [(1, " ".join(item).upper()), (2, "short one"), (3, None), (4, " "), (1, "short one"), (None, " ".join(item))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows)
    found = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontamination.leaks(docs, tests).collect()}
    assert found == {x for x in brute.leaks(rows, [i for i in items if i[0]]) if x[0]}
    assert (2, 1, 36, 36) in found and (5, 2, 1, 1) in found
    assert {r.doc_id for r in decontamination.without_leaks(docs, tests).collect()} == {3, 4, 6, None}
    assert decontamination.leaks(awkward[1], tests.where("false")).collect() == []
    assert decontamination.leaks(nothing, tests).collect() == []
    assert decontamination.without_leaks(awkward[1], tests.where("false")).count() == len(awkward[0])


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=byte_bpe.read_ranks(queries.RANKS),
                             special_tokens={})


@pytest.mark.parametrize("which", ["awkward", "given"])
def test_bpe(request, which, reference):
    rows, docs = request.getfixturevalue(which)
    coded = byte_bpe.encode(docs, queries.RANKS, queries.PATTERN)
    found = byte_bpe.decode(coded, queries.RANKS).collect()
    got = collections.Counter((r.doc_id, tuple(r.token_ids), bytes(r.bytes)) for r in found)
    assert got == collections.Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_bpe_of_random_texts(reference):
    rng = random.Random(7)
    alphabet = " \n\t\r  aabcdeThe'stll1234.,!!éüñ中文字😀ab\xa0 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abn ") for _ in range(200)) for _ in range(300)]
    texts += ["a" * 700, " " * 300, "=" * 1000, "aab" * 300, "\n" * 50 + "x", "中" * 900, "x ", " x", " ", ""]
    import numpy as np
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(queries.RANKS), queries.PATTERN)
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == reference.encode_ordinary(text), repr(text)


def test_bpe_in_groups_and_by_either_way_of_merging(reference, monkeypatch):
    import pyarrow as pa
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeinrsté") for _ in range(rng.randrange(1, 70))) for _ in range(1500)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "!!", "'s", "\n", " ", "\xa0", "\u3000", "×", "ɏ"])
                      for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "", " ", "\x1c \x1f x", "\u2014 \u201c \u2028 y"]
    expected = [reference.encode_ordinary(t or "") for t in texts]
    for short, group, part in ((5, 1 << 23, 1 << 19), (1, 3000, 500), (0, 1, 1)):
        monkeypatch.setattr(byte_bpe, "PLACE", short)
        monkeypatch.setattr(byte_bpe, "SHORT", 1 << short)
        monkeypatch.setattr(byte_bpe, "GROUP", group)
        monkeypatch.setattr(byte_bpe, "SLICE", part)
        encoder = byte_bpe.Encoder(byte_bpe.read_ranks(queries.RANKS), queries.PATTERN)
        column = pa.array(["left out", *texts]).slice(1)
        found = [(i, j, ids.to_pylist()) for ids, i, j in encoder.coded(column)]
        assert [i for i, _, _ in found] == [0, *[j for _, j, _ in found[:-1]]]
        assert [x for *_, own in found for x in own] == expected


def test_bpe_calls_nothing_once_per_word():
    encoder = byte_bpe.Encoder(byte_bpe.read_ranks(queries.RANKS), queries.PATTERN)
    rng = random.Random(9)
    texts = [" " + " ".join("".join(rng.choice("aeinorst") for _ in range(12)) for _ in range(200)) for _ in range(200)]
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert calls < 20_000  # 40,000 different words


def test_bpe_edges(spark, nothing, tmp_path):
    rows = spark.createDataFrame([(1, [0, 99_999_999, -4, 1]), (2, None), (3, []), (4, [None, 1])], "doc_id long, token_ids array<int>")
    got = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(rows, queries.RANKS).collect()}
    ranks = {v: k for k, v in byte_bpe.read_ranks(queries.RANKS).items()}
    assert got == {1: ranks[0] + ranks[1], 2: b"", 3: b"", 4: ranks[1]}
    assert byte_bpe.decode(byte_bpe.encode(nothing, queries.RANKS, queries.PATTERN), queries.RANKS).collect() == []
    (tmp_path / "few").write_text("YQ== 0\n")
    with pytest.raises(InputProblem):
        byte_bpe.Merges(byte_bpe.read_ranks(str(tmp_path / "few")))


def test_packing(spark, nothing, tmp_path):
    rng = random.Random(6)
    rows = [(k, [rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 31, 32, 33, 64, 100, 320]))]) for k in range(400)]
    rows += [(900, None), (None, [1, 2, 3]), (5, rows[5][1])]
    frame = spark.createDataFrame(rows, "doc_id long, token_ids array<int>")
    packed = packing.packed(frame, row=32, pad=-1, pool=2000)
    back = collections.Counter()
    parts = collections.defaultdict(list)
    for r in packed.collect():
        assert len(r.ids) == len(r.position_ids) == 32 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.ids[r.n_tokens:] == [-1] * (32 - r.n_tokens)
        for k, (i, p) in enumerate(zip(r.doc_ids, r.parts)):
            a, b = r.cu_seqlens[k:k + 2]
            assert r.position_ids[a:b] == list(range(b - a)) and b > a
            parts[i].append((p, r.ids[a:b]))
    for i, ids in rows:
        if ids and i != 5:
            assert [x for _, part in sorted(parts[i]) for x in part] == ids
    back.update(len(p) for own in parts.values() for _, p in own)
    assert sum(n * c for n, c in back.items()) == sum(len(ids or []) for _, ids in rows)
    packing.write_matrices(packed, str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == packed.count() and len(written.first().ids) == 4 * 32
    assert packing.packed(nothing.select("doc_id", F.array().cast("array<int>").alias("token_ids"))).collect() == []
    with pytest.raises(InputProblem):
        packing.packed(frame, row=0)


def test_best_fit_decreasing_by_linear_search():
    import numpy as np
    rng = random.Random(2)
    for _ in range(30):
        row = rng.choice([1, 7, 64, 100])
        lengths_ = np.array([rng.randrange(1, row + 1) for _ in range(rng.randrange(0, 80))], np.int64)
        free, expected = [], []
        for part in sorted(range(len(lengths_)), key=lambda k: (-lengths_[k], k)):
            fits = [f for f in free if f >= lengths_[part]]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - lengths_[part])
            else:
                free.append(row - lengths_[part])
        expected = sorted(row - f for f in free)
        rows = packing.best_fit_decreasing(lengths_, row)
        assert sorted(int(lengths_[p].sum()) for p in rows) == expected
        assert sorted(k for p in rows for k in p) == list(range(len(lengths_)))


def test_length_histogram(spark, awkward, reference, nothing):
    rows, docs = awkward
    counts = lengths.token_counts(docs, queries.RANKS, queries.PATTERN)
    assert counts.columns[-1] == "n_tokens"
    own = sorted(len(reference.encode_ordinary(t or "")) for _, t in rows)
    sums = lengths.histogram(counts)
    for r in sums.collect():
        n = r.n_tokens
        assert r.documents == own.count(n) and r.tokens == n * r.documents
        assert r.documents_up_to == sum(x <= n for x in own) and r.documents_from == sum(x >= n for x in own)
        assert r.tokens_up_to == sum(x for x in own if x <= n) and r.tokens_from == sum(x for x in own if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in own)
    for r in lengths.under_limits(sums, [0, 1, 100, 1500, 10**6]).collect():
        c = r.context_limit
        assert (r.documents, r.tokens, r.documents_over) == (len(own), sum(own), sum(x > c for x in own))
        assert r.tokens_kept == sum(min(x, c) for x in own) and r.tokens_lost == r.tokens - r.tokens_kept
    for r in lengths.quantiles(sums, [0, 0.25, 0.5, 1]).collect():
        assert r.n_tokens == own[max(0, -(-int(r.share * 100) * len(own) // 100) - 1)]
    none = lengths.histogram(lengths.token_counts(nothing, queries.RANKS, queries.PATTERN))
    assert none.collect() == [] and lengths.under_limits(none, [5]).first().tokens == 0
    assert lengths.quantiles(none, [0.5]).first().n_tokens is None
    with pytest.raises(InputProblem):
        lengths.under_limits(sums, [])


def test_length_report(spark, given):
    """Every row of op10's report against the encoded lengths themselves."""
    rows, docs = given
    sizes = sorted(r.n_tokens for r in lengths.token_counts(docs, queries.RANKS, queries.PATTERN).select("n_tokens").collect())
    found = collections.defaultdict(list)
    for r in queries.op10_length_histogram(spark, FOLDER).collect():
        found[r.kind].append(r)
    assert {r.n_tokens: (r.documents, r.documents_up_to, r.tokens_from, r.truncated_total) for r in found["length"]} == {
        n: (sizes.count(n), sum(x <= n for x in sizes), sum(x for x in sizes if x >= n), sum(min(x, n) for x in sizes))
        for n in set(sizes)}
    assert {r.n_tokens: (r.documents, r.tokens, r.documents_over, r.truncated_total, r.tokens_lost) for r in found["limit"]} == {
        c: (len(sizes), sum(sizes), sum(x > c for x in sizes), sum(min(x, c) for x in sizes), sum(max(0, x - c) for x in sizes))
        for c in queries.LIMITS}
    assert {r.share: r.n_tokens for r in found["quantile"]} == {
        s: next(n for k, n in enumerate(sizes, 1) if k >= s * len(sizes)) for s in queries.SHARES}


@pytest.mark.parametrize("languages", [1, 4, 60])
def test_quality_verdicts_by_brute_force(spark, languages):
    """Nearest language, both distances and the verdict, by plain Python from the definitions in the module."""
    rng = random.Random(languages)
    words = {k: ["%s%d" % ("abcdefgh"[k % 8], rng.randrange(5000)) for _ in range(200)] for k in range(languages)}
    rows = []
    for i in range(240 if languages < 60 else 400):
        k = i % languages
        own = [words[k][min(int(rng.expovariate(0.04)), 199)] for _ in range(rng.choice([15, 45, 120, 400]))]
        if i % 11 == 0:
            own = ["zz%d" % rng.randrange(10**6) for _ in own]
        if i % 13 == 0:
            own = ["%s##%d" % (x.upper(), rng.randrange(9)) for x in own]
        rows.append((i, " ".join(own), None if i % 17 == 0 else "l%02d" % k))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = brute.quality(rows, quality_rules)
    for r in quality_rules.judged(docs).collect():
        name, word_far, char_far, kept = expected[r.doc_id]
        assert r.nearest_lang == name and r.kept == kept, r
        for got, far in ((r.word_distance, word_far), (r.char_distance, char_far)):
            assert (got is None) == (far is None) and (far is None or abs(got - far) < 1e-9), r
    assert 0 < sum(e[3] for e in expected.values()) < len(rows)
