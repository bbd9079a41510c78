"""Language identification by prediction by partial matching (PPM) over bytes.

Method. Every language has a tree of byte contexts of up to ``ORDER`` bytes. The next byte is predicted by the longest
context the tree knows; a byte that has not followed it costs an escape, and the next shorter context is asked, down to
all bytes alike. With n symbols seen after a context, d of them different, a symbol seen c times has probability
c / (n + d) and the escape d / (n + d). Statistics are frozen after training, so a text's code length in a language is an
exact sum over its bytes, and the language with the shortest code is predicted.

Training counts every byte of every training text: tasks sum four-byte strings by language, Spark sums them over tasks.
The trees are pruned to the ``NODES`` most frequent strings per order and language (ties: the smaller string), a model size
like any other, so what is sent to the tasks has a bound: languages x orders x ``NODES``. The tables of all languages are
merged: a string that any tree knows has its finished code length for each language, so most bytes need one look-up.

The score is the share of the predicted language among all, from code lengths per byte: exp(-TEMPER * bits / bytes),
normalised. 1 / (number of languages) is a guess.

Edge cases. Null texts and texts without a letter are ``und`` with score 0. Without any training text every prediction is
``und``. Ties go to the smaller language name. Very long texts are scored whole, in stretches. Other columns than the
named ones are neither read nor used for a prediction. More than ``MOST_LANGS`` languages are refused: they are no
languages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.llm.words import U64, bytes_of, lean, mixed, slices
from patronage.scratch import stored

ORDER = 3  # bytes of context
NODES = 100_000
MOST_LANGS = 256
TEMPER = 8.0
UNKNOWN = "und"
# Bytes of text counted or scored at once, and strings a task holds before it passes their counts on.
STRETCH = 1 << 18
HELD = 1 << 20


def held_out(id_column: Column) -> Column:
    """The fifth of the ids that is never learned from."""
    return F.crc32(id_column.cast("string")) % 5 == 0


def strings_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the string of it and the ``ORDER`` bytes before it in its text as a number; before a text stand zeros."""
    out = data.astype(np.uint32)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        prior = np.zeros(len(data), np.uint32)
        prior[k:] = data[:-k]
        prior[place < k] = 0
        out |= prior << np.uint32(8 * k)
    return out


def counted_strings(rows: DataFrame) -> DataFrame:
    """lang, string, n: strings of ORDER + 1 bytes of all texts. ``rows``: lang, text."""
    def run(batches):
        lean()
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            data, offsets = bytes_of(batch.column(1))
            for i, j in slices(offsets, STRETCH):
                strings = strings_of(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                owner = np.repeat(codes[i:j], np.diff(offsets[i:j + 1]))
                for code in np.unique(codes[i:j]):
                    found, n = np.unique(strings[owner == code], return_counts=True)
                    held.setdefault(names[code], []).append((found, n))
                    size += len(found)
            if size >= HELD:
                yield from _summed(held)
                held, size = {}, 0
        yield from _summed(held)

    return rows.mapInArrow(run, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n"))


def _summed(held: dict):
    for name, parts in held.items():
        strings, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(strings)).astype(np.int64)
        yield pa.record_batch([pa.array([name] * len(strings), pa.string()), pa.array(strings.astype(np.int64)),
                               pa.array(n)], names=["lang", "string", "n"])


def trained(rows: DataFrame, nodes: int = NODES) -> list[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """For order 0 to ORDER and each language: strings (context and symbol) and their counts, the most frequent ones."""
    counts = stored(counted_strings(rows), "strings")
    langs = counts.select("lang").distinct().limit(MOST_LANGS + 1).collect()
    if len(langs) > MOST_LANGS:
        raise InputProblem(f"There are more than {MOST_LANGS} languages to learn.", "Map them to fewer names first.")
    out = []
    for order in range(ORDER + 1):
        short = counts.groupBy("lang", F.col("string").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("string")).agg(
            F.sum("n").alias("n"))
        # A heavy language's strings are first cut down within 64 parts, so no task ranks all of them.
        part = F.pmod(F.xxhash64("string"), F.lit(64))
        for keys in (["lang", part], ["lang"]):
            best = W.partitionBy(*keys).orderBy(F.desc("n"), "string")
            short = short.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= nodes).drop("_place")
        table = short.toArrow()
        names = np.array(table["lang"].to_pylist(), object)
        strings, n = table["string"].to_numpy().astype(np.uint32), table["n"].to_numpy().astype(np.float64)
        own = {}
        for name in sorted(set(names)):
            at = np.flatnonzero(names == name)
            at = at[np.argsort(strings[at])]
            own[name] = (strings[at], n[at])
        out.append(own)
    return out


class Table:
    """Strings to rows by open addressing in NumPy: a look-up touches one or two places."""

    def __init__(self, strings: np.ndarray):
        self.bits = max(10, int(2 * len(strings)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        todo, place = np.arange(len(strings)), self._place(strings)
        self.steps = 0
        while len(todo):
            self.steps += 1
            free = self.keys[place[todo]] < 0
            took = todo[free][np.unique(place[todo[free]], return_index=True)[1]]
            self.keys[place[took]], self.rows[place[took]] = strings[took], took
            todo = todo[self.keys[place[todo]] != strings[todo]]
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)

    def _place(self, strings: np.ndarray) -> np.ndarray:
        return (mixed(strings.astype(U64)) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, strings: np.ndarray) -> np.ndarray:
        """Row of each string, or -1."""
        place = self._place(strings)
        key = self.keys[place]
        out = np.where(key == strings, self.rows[place], -1)
        open_ = np.flatnonzero((key != strings) & (key >= 0))
        for _ in range(self.steps):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            key = self.keys[place[open_]]
            hit = key == strings[open_]
            out[open_[hit]] = self.rows[place[open_[hit]]]
            open_ = open_[~hit & (key >= 0)]
        return out


class Trees:
    """Code lengths in bits of every known string in every language."""

    def __init__(self, model: list[dict]):
        self.langs = sorted({name for order in model for name in order})
        self.levels = []  # per order: (table of strings, their code lengths, table of contexts, their escape lengths)
        for order, trees in enumerate(model):
            strings = np.unique(np.concatenate([trees[name][0] for name in self.langs])).astype(np.int64)
            contexts = np.unique(strings >> 8)
            bits = np.full((len(strings), len(self.langs)), np.nan, np.float32)
            escape = np.zeros((len(contexts), len(self.langs)), np.float32)
            for k, name in enumerate(self.langs):
                own, n = trees[name]
                own = own.astype(np.int64)
                context, back = np.unique(own >> 8, return_inverse=True)
                total, different = np.bincount(back, n), np.bincount(back)
                bits[np.searchsorted(strings, own), k] = np.log2((total + different)[back] / n)
                escape[np.searchsorted(contexts, context), k] = np.log2((total + different) / different)
            missing = np.isnan(bits)
            lower = self._bits(order - 1, strings & ((1 << 8 * order) - 1)) + \
                escape[np.searchsorted(contexts, strings >> 8)]
            bits[missing] = lower[missing]
            self.levels.append((Table(strings), bits, Table(contexts), escape))

    def _bits(self, order: int, strings: np.ndarray) -> np.ndarray:
        """(strings, languages) code lengths of the last byte of each string of order + 1 bytes."""
        if order < 0:
            return np.full((len(strings), len(self.langs)), 8, np.float32)
        table, bits, contexts, escape = self.levels[order]
        row = table.find(strings)
        out = bits[row]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            lower = self._bits(order - 1, strings[lost] & ((1 << 8 * order) - 1))
            above = contexts.find(strings[lost] >> 8)
            lower += np.where((above >= 0)[:, None], escape[above], 0)
            out[lost] = lower
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) bits of each text."""
        strings = strings_of(data, offsets).astype(np.int64)
        sums = np.zeros((len(strings) + 1, len(self.langs)))
        for i in range(0, len(strings), STRETCH):
            np.cumsum(self._bits(ORDER, strings[i:i + STRETCH]), axis=0, dtype=np.float64,
                      out=sums[i + 1:i + STRETCH + 1])
            sums[i + 1:i + STRETCH + 1] += sums[i]
        return sums[offsets[1:]] - sums[offsets[:-1]]


def predicted(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text: str = "text",
              lang: str = "lang") -> DataFrame:
    """id column, lang_pred, score of every row of ``docs``; learned from ``text`` and ``lang`` of ``training``."""
    require_columns(docs, id_column, text)
    require_columns(training, text, lang)
    rows = training.select(field(lang).cast("string").alias("lang"), field(text).alias("text")).where(
        "lang is not null and text is not null")
    model = trained(rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_column].dataType.simpleString()
    letter = re.compile(r"[^\W\d_]")

    def run(batches):
        lean()
        trees = Trees(sent.value) if sent.value[0] else None
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            for i, j in slices(offsets, STRETCH):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                names, scores = [UNKNOWN] * (j - i), np.zeros(j - i)
                if trees is not None:
                    size = np.diff(offsets[i:j + 1])
                    bits = trees.code_lengths(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    weight = np.exp(-TEMPER * (bits - bits.min(axis=1)[:, None]) / np.maximum(size, 1)[:, None])
                    best = bits.argmin(axis=1)
                    share = weight[np.arange(j - i), best] / weight.sum(axis=1)
                    for t, x in enumerate(texts):
                        if x and letter.search(x):
                            names[t], scores[t] = trees.langs[best[t]], share[t]
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(names, pa.string()),
                                       pa.array(np.round(scores, 6))], names=["id", "lang_pred", "score"])

    out = docs.select(field(id_column).alias("id"), field(text).alias("text")).mapInArrow(
        run, f"id {id_type}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_column)
