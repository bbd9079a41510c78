"""Toxicity by class-conditional Kneser-Ney models.

Method. Two interpolated modified Kneser-Ney models, of toxic and of ordinary labelled texts, back off from a word after the
one before it to the word, and from there to *shared* continuation counts over both classes: after how many different words
does a word stand? Each class has its own three discounts per order, from its counts of counts, and what they take away is
what the next lower order gets, so after every context the probabilities of all words, and of one that stands for any word
never seen, add up to one. A rare expression is left mostly to the shared counts, which say the same of both classes.

A text's score compares its log-likelihoods per word. The log-ratio of the classes is an exact sum of two parts: the *evidence*
of words and pairs that were counted, and the log-ratio of the shares that contexts *leave* to the lower order. Means of both,
and the evidence of the strongest and second strongest word, since a long text may be toxic in one place, are weighed by a
logistic regression on labelled texts that the models have not seen, at most ``CALIBRATION`` of them (those with the smallest
hashed ids), its only sample. The models count all other labelled texts.

Size of the models: every word and pair of the labelled texts, so they grow with them. They are tables; no task and not the
driver holds one. What most look-ups ask for is sent to all tasks: the most frequent words and pairs, at most ``HEAD_WORDS`` and
``HEAD_PAIRS``. Look-ups of all others are rows (text, key), joined with the rest of the tables and summed per text, so results do
not depend on the two numbers; ``PASSES`` parts of the keys are joined one after the other, to shuffle a part at a time. A bitmap of fixed size spares the join most keys that the models lack, and loses none they have.

Edge cases. Null and blank texts have no words; their score is the share of toxic labels. Without labels of both
kinds every score is the share of toxic labels (0 without any). Null labels are ignored; an id with several labels is
toxic if one of them says so. Texts are scored from their words alone, so equal texts score alike. Rows without an id are
scored and never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.llm.decontamination import key_filter
from patronage.llm.ids import require_whole_ids
from patronage.llm.membership import maybe_in, only
from patronage.llm.perplexity import OPEN, _discounts
from patronage.llm.tokens import before, find, pair_hash, separators
from patronage.llm.words import BASES, U64, Hasher, as_long, lean, lower_table, pieces
from patronage.scratch import discard, stored, tidy

CALIBRATION = 20_000
# Words of a task that are counted together.
HELD = 1 << 20
# Bounds of what is sent to all tasks: 6 MB of words, 32 MB of pairs, a bitmap of 2^27 bits.
HEAD_WORDS, HEAD_PAIRS, FILTER = 1 << 18, 1 << 21, 27
# Parts of the keys that are joined one after the other, so that only a part of the look-ups is shuffled at any time.
PASSES = 4
CLASSES = {"toxic": 1, "ordinary": -1}


def fold(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string")) % 4


def _tokens(batch_texts: pa.Array, parting, folded, hasher):
    for i, j, w in pieces(batch_texts, parting, folded):
        yield i, j, w, hasher.of_words(w) | U64(1)


def counted_pairs(rows: DataFrame) -> DataFrame:
    """left, right (hashes of a word and the one before it, ``OPEN`` before a text), toxic, ordinary: occurrences in texts of
    each class. ``rows``: text, toxic."""
    names = ["left", "right", "toxic", "ordinary"]

    def summed(held):
        if held:
            left, right, label = [np.concatenate(c) for c in zip(*held)]
            order = np.argsort(pair_hash(left, right))
            left, right, label = left[order], right[order], label[order]
            new = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
            toxic, n = np.add.reduceat(label, new), np.diff(np.append(new, len(left)))
            yield pa.record_batch([as_long(left[new]), as_long(right[new]), pa.array(toxic), pa.array(n - toxic)], names=names)

    def run(batches):
        lean()
        parting, folded, hasher = separators(), lower_table(), Hasher(BASES[0])
        held, size = [], 0
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for i, j, w, hashes in _tokens(batch.column(0), parting, folded, hasher):
                held.append((before(hashes, w.first, OPEN), hashes, np.repeat(toxic[i:j], w.counts()).astype(np.int64)))
                size += len(hashes)
                if size >= HELD:
                    yield from summed(held)
                    held, size = [], 0
        yield from summed(held)

    return rows.select("text", "toxic").mapInArrow(run, "left long, right long, toxic long, ordinary long").groupBy(
        "left", "right").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


@dataclass
class Model:
    """``words``: word, n, evidence, rest; ``pairs``: key, n, evidence. Evidence is the log-ratio of the classes' probabilities
    over those of the next lower order alone, ``rest`` that of the shares which a context leaves to the lower order, and
    ``rest_of_words`` that of the words' shares. ``many_words`` and ``many_pairs``: n from which rows are sent to all tasks."""

    words: DataFrame
    pairs: DataFrame
    many_words: int
    many_pairs: int
    rest_of_words: float


def _lost(c: str, d: list[float]) -> Column:
    """What the discounts take from a count."""
    return F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def _many(table: DataFrame, most: int) -> int:
    """The smallest n, up to 64 or a power of two, for which at most ``most`` rows have an n as large."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin("n")) - 1)
    levels = table.groupBy(F.when(F.col("n") < 64, F.col("n")).otherwise(power).alias("least")).count().collect()
    many, rows = 1 << 62, 0
    for level in sorted(levels, key=lambda r: -r["least"]):
        rows += level["count"]
        if rows > most:
            break
        many = level["least"]
    return many


def _beside(pairs: DataFrame, words: DataFrame, side: str, columns: list[str], many: int) -> DataFrame:
    """The pairs with ``columns`` of the word on one side. Frequent words, in number at most ``HEAD_WORDS``, are sent to the pairs;
    only pairs of rare words are shuffled, so no word is too frequent for a task."""
    named = words.select(F.col("word").alias(side), "n", *columns)
    often, seldom = F.broadcast(named.where(F.col("n") >= many).drop("n")), named.where(F.col("n") < many).drop("n")
    return pairs.join(often, side).unionByName(pairs.join(often.select(side), side, "left_anti").join(seldom, side))


def trained(rows: DataFrame) -> Model | None:
    """The two models of ``rows`` (text, toxic), or None unless both classes have words."""
    pairs = stored(counted_pairs(rows), "word-pairs")
    sums = pairs.agg(*[F.sum(c).alias(c) for c in CLASSES], F.count("*").alias("different")).first()
    if not sums["toxic"] or not sums["ordinary"]:
        return None

    def discounts(table):
        return {c: _discounts(table.where(F.col(c) > 0).select(F.col(c).alias("n"))) for c in CLASSES}

    seen = stored(pairs.groupBy(F.col("right").alias("word")).agg(
        *[F.sum(c).alias(c) for c in CLASSES], F.count("*").alias("different")), "words")
    of_words, of_pairs = discounts(seen), discounts(pairs)
    lost = seen.agg(*[F.sum(_lost(c, of_words[c])).alias(c) for c in CLASSES]).first()
    rest = {c: lost[c] / sums[c] for c in CLASSES}
    shared = F.col("different") / F.lit(sums["different"] + 1.0)
    contexts = pairs.groupBy(F.col("left").alias("word")).agg(
        *[F.sum(c).alias(f"after_{c}") for c in CLASSES], *[F.sum(_lost(c, of_pairs[c])).alias(f"left_{c}") for c in CLASSES])

    def own(c):
        return (F.col(c) - _lost(c, of_words[c])) / F.lit(float(sums[c]))

    def added(parts):
        return parts["toxic"] - parts["ordinary"]

    words = stored(seen.join(contexts, "word", "full").select(
        "word", F.greatest(F.coalesce(F.col("toxic") + F.col("ordinary"), F.lit(0)),
                           F.coalesce(F.col("after_toxic") + F.col("after_ordinary"), F.lit(0))).alias("n"),
        F.coalesce(added({c: F.log1p(own(c) / (F.lit(rest[c]) * shared)) for c in CLASSES}), F.lit(0.0)).alias("evidence"),
        added({c: F.when(F.col(f"after_{c}") > 0, F.log(F.col(f"left_{c}") / F.col(f"after_{c}"))).otherwise(0.0)
               for c in CLASSES}).alias("rest"),
        *[(own(c) + F.lit(rest[c]) * shared).alias(f"p_{c}") for c in CLASSES],
        *[F.col(f"left_{c}") for c in CLASSES]), "word-evidence")
    many_words = _many(words, HEAD_WORDS)
    beside = _beside(_beside(pairs, words, "right", [f"p_{c}" for c in CLASSES], many_words),
                     words, "left", [f"left_{c}" for c in CLASSES], many_words)
    evidence = added({c: F.when(F.col(c) > 0, F.log1p(
        (F.col(c) - _lost(c, of_pairs[c])) / (F.col(f"left_{c}") * F.col(f"p_{c}")))).otherwise(0.0) for c in CLASSES})

    def keyed(batches):
        for batch in batches:
            left, right = (batch.column(k).to_numpy().view(U64) for k in (0, 1))
            yield pa.record_batch([as_long(pair_hash(left, right)), *batch.columns[2:]], names=["key", "n", "evidence"])

    table = stored(beside.select("left", "right", (F.col("toxic") + F.col("ordinary")).alias("n"), evidence.alias("evidence"))
                   .mapInArrow(keyed, "key long, n long, evidence double"), "pair-evidence")
    discard(pairs)
    discard(seen)
    return Model(words.select("word", "n", "evidence", "rest"), table, many_words, _many(table, HEAD_PAIRS),
                 float(np.log(rest["toxic"] / rest["ordinary"])))


def _sorted(table: DataFrame, key: str, *columns: str) -> list[np.ndarray]:
    """Keys in order and the other columns."""
    found = table.select(key, *columns).toArrow()
    keys = found[key].to_numpy().view(U64)
    order = np.argsort(keys)
    return [keys[order], *[found[c].to_numpy()[order] for c in columns]]


def _wanted(text: np.ndarray, key: np.ndarray, n: np.ndarray, after: np.ndarray):
    """Distinct (text, key) with sums of n and after."""
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))) if len(text) else np.zeros(0, int)
    sums = [np.add.reduceat(x[order], new) if len(new) else np.zeros(0, np.int64) for x in (n, after)]
    return text[new], key[new], *sums


def _looked_up(rows: DataFrame, model: Model) -> DataFrame:
    """Two kinds of rows. Without a key: number of the row, its columns but ``text``, words, evidence, rest, best, second from the
    frequent words and pairs. With a key: number of the row, key, n occurrences, of which ``after`` have a word after them."""
    often, pairs_often = F.col("n") >= model.many_words, F.col("n") >= model.many_pairs
    keys = model.words.where(~often).select(F.array("word").alias("keys")).unionByName(
        model.pairs.where(~pairs_often).select(F.array("key").alias("keys")))
    sent = rows.sparkSession.sparkContext.broadcast((
        _sorted(model.words.where(often), "word", "evidence", "rest"), _sorted(model.pairs.where(pairs_often), "key", "evidence"),
        key_filter(keys, FILTER)))
    others = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in others]
    rest_of_words = model.rest_of_words
    columns = [*names, "row", "words", "evidence", "rest", "best", "second", "key", "n", "after"]

    def looked_up(table, keys, at):
        hit = at >= 0
        value = np.zeros(len(keys))
        value[hit] = table[at[hit]]
        return value

    def run(batches):
        lean()
        parting, folded, hasher = separators(), lower_table(), Hasher(BASES[0])
        (words, of_words, of_contexts), (pairs, of_pairs), filled = sent.value
        at_text, row = len(names), TaskContext.get().partitionId() << 40
        opening = int(find(words, np.array([OPEN], U64))[0])
        for batch in batches:
            for i, j, w, hashes in _tokens(batch.column(at_text), parting, folded, hasher):
                n, text = w.counts(), w.text_of_word()
                place = find(words, hashes)
                key = pair_hash(before(hashes, w.first, OPEN), hashes)
                pair_place = find(pairs, key)
                own = looked_up(of_words, hashes, place)
                value = own + looked_up(of_pairs, key, pair_place)
                rest = looked_up(of_contexts, hashes, before(place, w.first, opening)) + rest_of_words
                sums = [np.bincount(text, v, minlength=j - i) for v in (value, rest)]
                best, second = np.zeros(j - i), np.zeros(j - i)
                strong = np.flatnonzero(own > 0)
                strong = strong[np.lexsort((-own[strong], text[strong]))]
                first = np.searchsorted(text[strong], np.arange(j - i + 1))
                some, more = np.flatnonzero(np.diff(first) > 0), np.flatnonzero(np.diff(first) > 1)
                best[some], second[more] = own[strong[first[some]]], own[strong[first[more] + 1]]
                none = pa.nulls(j - i, pa.int64())
                yield pa.record_batch([*[batch.column(k).slice(i, j - i) for k in range(at_text)],
                                       pa.array(row + np.arange(j - i)), pa.array(n.astype(np.int64)), *map(pa.array, sums),
                                       pa.array(best), pa.array(second), none, none, none], names=columns)
                rare = np.flatnonzero(place < 0)
                rare = rare[maybe_in(filled, hashes[rare], FILTER)]
                rare_pairs = np.flatnonzero(pair_place < 0)
                rare_pairs = rare_pairs[maybe_in(filled, key[rare_pairs], FILTER)]
                # The context before a text, if it is a rare one itself.
                open_ = np.flatnonzero(n) if opening < 0 else np.zeros(0, int)
                last = np.zeros(len(hashes), np.int64)
                last[w.first[1:][n > 0] - 1] = 1
                one, zero = np.ones(len(rare) + len(rare_pairs), np.int64), np.zeros(len(open_), np.int64)
                wanted = _wanted(np.concatenate([text[rare], text[rare_pairs], open_]),
                                 np.concatenate([hashes[rare], key[rare_pairs], np.full(len(open_), OPEN)]),
                                 np.concatenate([one, zero]),
                                 np.concatenate([1 - last[rare], 0 * one[len(rare):], zero + 1]))
                many = len(wanted[0])
                yield pa.record_batch([*[pa.nulls(many, batch.column(k).type) for k in range(at_text)],
                                       pa.array(row + wanted[0]), pa.nulls(many, pa.int64()),
                                       *[pa.nulls(many, pa.float64()) for _ in range(4)], as_long(wanted[1]),
                                       pa.array(wanted[2].astype(np.int64)), pa.array(wanted[3].astype(np.int64))], names=columns)
                row += j - i

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], "row long, words long, evidence double, "
                        "rest double, best double, second double, key long, n long, after long"])
    # Written: the number of a row must be the same wherever it is read.
    found = stored(rows.select(*names, "text").mapInArrow(run, schema), "looked-up")
    sent.destroy()
    return found


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """The rows with ``text`` replaced by mean and rest: evidence and shares left to lower orders per word (null without words),
    and by best and second: evidence of the two strongest words, 0 at least."""
    names = [c for c in rows.columns if c != "text"]
    found = _looked_up(rows, model)
    rare = model.words.where(F.col("n") < model.many_words).select(
        F.col("word").alias("key"), "evidence", "rest", F.lit(True).alias("word")).unionByName(
        model.pairs.where(F.col("n") < model.many_pairs).select("key", "evidence", F.lit(0.0).alias("rest"), F.lit(False).alias("word")))
    strong = F.when(F.col("word") & (F.col("evidence") > 0) & (F.col("n") > 0),
                    F.array_repeat("evidence", F.least("n", F.lit(2)).cast("int")))
    sums = [F.sum("more_evidence").alias("more_evidence"), F.sum("more_rest").alias("more_rest"),
            F.flatten(F.collect_list("more_strong")).alias("more_strong")]
    value = [(F.col("n") * F.col("evidence")).alias("more_evidence"), (F.col("after") * F.col("rest")).alias("more_rest"),
             strong.alias("more_strong")]
    parts = []
    for k in range(PASSES):
        own = F.pmod(F.shiftright("key", 32), F.lit(PASSES)) == k
        parts.append(stored(found.where(own).select("row", "key", "n", "after").join(rare.where(own), "key").select(
            "row", *value).groupBy("row").agg(*sums), "rare-evidence"))
    more = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*sums)
    whole = found.where("key is null").drop("key", "n", "after").join(more, "row", "left")
    zero = F.lit(0.0)
    top = F.sort_array(F.concat(F.array("best", "second"), F.coalesce("more_strong", F.array().cast("array<double>"))), False)
    out = stored(whole.select(
        *names, ((F.col("evidence") + F.coalesce("more_evidence", zero)) / F.nullif("words", F.lit(0))).alias("mean"),
        ((F.col("rest") + F.coalesce("more_rest", zero)) / F.nullif("words", F.lit(0))).alias("rest"),
        top[0].alias("best"), top[1].alias("second")), "evidence")
    for table in (found, *parts):
        discard(table)
    return out


FEATURES = {"mean": 10.0, "rest": 10.0, "best": 1.0, "second": 1.0}


def _features(columns: dict) -> np.ndarray:
    return np.column_stack([np.ones(len(columns["mean"])), *[scale * columns[c] for c, scale in FEATURES.items()]])


def calibrated(rows: list) -> tuple[np.ndarray | None, float]:
    """Weights of the logistic regression, and the share of toxic rows."""
    rows = [r for r in rows if r["mean"] is not None]
    y = np.array([r["toxic"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None, float(y.mean()) if len(y) else 0.0
    x = _features({c: np.array([r[c] for r in rows]) for c in FEATURES})
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.1] * len(FEATURES)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ weights)
        weights += step * min(1.0, 3.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return weights, float(y.mean())


def _weighed(docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column) -> tuple:
    """Evidence of the rows of ``docs`` (id, text), weights, and the share of toxic labels; None and None if there are no weights."""
    marks = labels.where("id is not null and toxic in (0, 1)").where(learn | calibrate).groupBy("id").agg(
        F.max("toxic").alias("toxic"))
    named = docs.select(F.col("id").cast("long").alias("id"), "text")
    known = stored(only(named, marks).join(marks, "id").select("id", "toxic", "text"), "labelled")
    places = known.where(calibrate).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(CALIBRATION)
    sampled = stored(places, "calibration")
    model = trained(known.join(F.broadcast(sampled), "id", "left_anti").select("text", "toxic"))
    if model is None:
        return None, None, known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    sample = stored(known.join(F.broadcast(sampled), "id", "left_semi").select("id", "toxic").distinct(), "sample")
    discard(known)
    # The sample is looked up with all other rows, in one pass.
    found = evidence(docs, model)
    discard(model.words)
    discard(model.pairs)
    # Rows that share an id count as one, so that the sample has its bound.
    weights, share = calibrated(found.withColumn("id", F.col("id").cast("long")).join(
        F.broadcast(sample), "id").groupBy("id", "toxic").agg(*[F.avg(c).alias(c) for c in FEATURES]).collect())
    return found, weights, share


def scored(docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column, id_column: str = "doc_id",
           text: str = "text", label: str = "toxic") -> DataFrame:
    """id column and score (0 to 1) of every row of ``docs``.

    ``labels``: id column and ``label`` (0 or 1). ``learn`` and ``calibrate`` are conditions on the column ``id`` that say
    which labels train the models and which may weigh the evidence; all others are not looked at. Of the latter, those
    beyond the sample of ``CALIBRATION`` train the models too.
    """
    require_whole_ids(docs, id_column)
    require_whole_ids(labels, id_column)
    require_columns(docs, text)
    require_columns(labels, label)
    spark = docs.sparkSession
    # Results are built from stored tables, outside.
    with tidy(spark):
        found, weights, share = _weighed(docs.select(field(id_column).alias("id"), field(text).alias("text")),
                                         labels.select(field(id_column).cast("long").alias("id"),
                                                       field(label).cast("int").alias("toxic")), learn, calibrate)
    if weights is None:
        return docs.select(field(id_column), F.lit(float(share)).alias("score"))
    logit = sum((F.col(c) * F.lit(float(w) * scale) for (c, scale), w in zip(FEATURES.items(), weights[1:])),
                F.lit(float(weights[0])))
    return found.select(F.col("id").alias(id_column), F.round(F.coalesce(1 / (1 + F.exp(-logit)), F.lit(float(share))), 6).alias("score"))
