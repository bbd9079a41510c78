"""Quality rules: base counts, and how far a text's histograms lie from those of its language.

Method. Every language of the table gives two reference histograms, counted over all its documents: classes of characters,
and its ``COMMON`` most frequent words (lower-cased A-Z; everything else is one more cell). A text is measured against
each language by the Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1) and judged by the language
whose words are nearest, as a share of that language's distance from a text without any of its common words. It is rejected
when its character distance or its word distance is over a limit, or when it lacks the common words of every language:
``NEAR`` of that distance or more where ``EXPECTED`` common words stand in a text of its length, none at all where chance
leaves a text without one less often than ``RARE``. A language whose words are too even for that at a text's length vouches
only for texts that are said to be in it. Short texts have coarse histograms, so each distance only counts from a
minimum length on, and the base rules reject texts that are very short or mostly repetition.

References are at most ``COMMON`` + 1 + 7 numbers a language and reach the driver; the counts behind them are summed in
tasks first and shuffled by word, so a hot word or source is one row per task.

Edge cases. A null or blank text has no words and fails the base rules. Documents without a language add to no reference.
If no language has a reference (an empty table, or no ``lang`` at all), only the base rules judge. Ties between common
words go to the smaller word, ties between languages to the smaller name. Repeated rows are judged alike. Other columns of the input are not looked at.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from patronage.columns import field, require_columns
from patronage.llm.words import BASES, U64, Hasher, Words, bytes_of, is_white, lean, lower_table, mixed, pieces

COMMON = 60
# Shortest texts that a distance judges: characters, words.
LEAST_CHARS, LEAST_WORDS = 300, 40
# Largest distances of a text that stays.
FAR_CHARS, FAR_WORDS = 0.30, 0.50
# Share of the distance of a text without common words at which a text lacks them, judged where so many are expected.
NEAR, EXPECTED = 0.90, 32
# Chance of a text without any common word below which it lacks them.
RARE = 1e-6
# Base rules.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
# Characters counted as symbols, and punctuation of ordinary sentences.
SYMBOLS = "#*$%&|<>"
POINTS = ".,;:!?'\"()-"
LOWER, UPPER, DIGIT, BLANK, POINT, OTHER, WIDE, NONE = range(8)
# Different words a task holds before it passes their counts on.
HELD = 100_000


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.int64)
    table[97:123], table[65:91], table[48:58] = LOWER, UPPER, DIGIT
    table[[9, 10, 11, 12, 13, 32]] = BLANK
    table[list(POINTS.encode())] = POINT
    table[128:192], table[192:] = NONE, WIDE
    return table


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[offsets])


def _char_histograms(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    cells = np.bincount(text * 8 + classes[data], minlength=8 * (len(offsets) - 1))
    return cells.reshape(-1, 8)[:, :NONE]


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> DataFrame:
    """lang, kind (``char`` or ``word``), cell, share: the two histograms of every language."""
    require_columns(docs, text, lang)
    rows = docs.select(field(lang).alias("lang"), field(text).alias("text")).where("lang is not null")

    def run(batches):
        lean()
        classes, fold = _classes(), lower_table()
        words, chars = {}, {}
        held = 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = bytes_of(batch.column(1))
            for i, name in enumerate(langs):
                part = data[offsets[i]:offsets[i + 1]]
                chars[name] = chars.get(name, 0) + np.bincount(classes[part], minlength=8)[:NONE]
                seen = words.setdefault(name, Counter())
                before = len(seen)
                seen.update(fold[part].tobytes().split())
                held += len(seen) - before
                if held >= HELD:
                    yield from _counted(words, {})
                    words, held = {}, 0
        yield from _counted(words, chars)

    counts = rows.mapInArrow(run, "lang string, kind string, cell binary, n long").groupBy("lang", "kind", "cell").agg(
        F.sum("n").alias("n"))
    total = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    best = counts.withColumn("_place", F.row_number().over(
        W.partitionBy("lang", "kind").orderBy(F.desc("n"), "cell"))).where(F.col("_place") <= common)
    return best.join(total, ["lang", "kind"]).select("lang", "kind", "cell", (F.col("n") / F.col("total")).alias("share"))


def _counted(words: dict, chars: dict):
    rows = itertools.chain(
        ((name, "word", w, n) for name, seen in words.items() for w, n in seen.items()),
        ((name, "char", b"%d" % k, int(n)) for name, cells in chars.items() for k, n in enumerate(cells)))
    while part := list(itertools.islice(rows, 20_000)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(
            zip(*part), (pa.string(), pa.string(), pa.binary(), pa.int64()))], names=["lang", "kind", "cell", "n"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` from the distribution ``q``."""
    m = (p + q) / 2

    def against(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)

    return np.sqrt(np.clip((against(p) + against(np.broadcast_to(q, p.shape))) / 2, 0, 1))


class Reference:
    """The histograms as arrays: words of all languages in one sorted table of hashes."""

    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        cells = sorted({bytes(r["cell"]) for r in rows if r["kind"] == "word"})
        body = b" ".join(cells)
        hashes = Hasher(BASES[0]).of_words(
            Words(np.frombuffer(body, np.uint8), np.array([0, len(body)]), is_white()))
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {cells[k]: i for i, k in enumerate(order)}
        self.words, self.shares, self.chars, self.bare = [], [], [], []
        for name in self.langs:
            own = [(place[bytes(r["cell"])], r["share"]) for r in rows if r["lang"] == name and r["kind"] == "word"]
            self.words.append(np.array([k for k, _ in own], np.int64))
            share = np.array([s for _, s in own])
            self.shares.append(np.append(share, max(0.0, 1 - share.sum())))
            without = np.append(np.zeros(len(share)), 1.0)[None, :]
            self.bare.append(max(distance(without, self.shares[-1])[0], 1e-9))
            chars = np.zeros(NONE)
            for r in rows:
                if r["lang"] == name and r["kind"] == "char":
                    chars[int(bytes(r["cell"]))] = r["share"]
            self.chars.append(chars)

    def distances(self, w, hashes: np.ndarray, chars: np.ndarray, named: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word distance, character distance, language index and lack of common words of each text of a slice; ``named``
        are the indices of the languages the texts are said to be in, or -1."""
        n = w.counts()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = np.flatnonzero(self.hashes[at] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        size = max(1, len(self.hashes))
        # The cells that occur only; a language's histograms are spread out one language at a time.
        cells, times = np.unique(w.text_of_word()[known] * size + at[known], return_counts=True)
        text, cell = np.divmod(cells, size)
        column = np.full(size, -1)
        far = np.ones((len(self.langs), len(n)))
        able, lacking = np.zeros(far.shape, bool), np.zeros(far.shape, bool)
        for k, (words, share) in enumerate(zip(self.words, self.shares)):
            column[words] = np.arange(len(words))
            here = column[cell] >= 0
            own = np.zeros((len(n), len(words)), np.int64)
            own[text[here], column[cell[here]]] = times[here]
            column[words] = -1
            p = np.column_stack([own, n - own.sum(axis=1)]) / np.maximum(n, 1)[:, None]
            far[k] = distance(p, share)
            many = n * (1 - share[-1]) >= EXPECTED
            some = n * np.log(max(share[-1], 1e-300)) <= np.log(RARE)
            able[k] = many | some
            lacking[k] = many & (far[k] > NEAR * self.bare[k]) | some & (own.sum(axis=1) == 0)
        texts = np.arange(len(n))
        said = (named >= 0) & ~able[named, texts]
        lacks = able.any(axis=0) & (lacking | ~able).all(axis=0) & ~said
        ratio = far / np.array(self.bare)[:, None]
        best = np.where(able | ~able.any(axis=0), ratio, np.inf).argmin(axis=0)
        best = np.where(said & lacking[best, texts], named, best)
        p = chars / np.maximum(chars.sum(axis=1), 1)[:, None]
        char_far = np.stack([distance(p, q) for q in self.chars])
        return far[best, texts], char_far[best, texts], best, lacks


def repeated_words(w, grams: np.ndarray, window: int) -> np.ndarray:
    """Words per text inside windows that occur twice or more in that text."""
    starts = np.flatnonzero(w.words_left() >= window)
    text = w.text_of_word()[starts]
    key = grams[starts] ^ mixed(text.astype(U64) + U64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w) + 1, np.int64)
    at = starts[twice]
    edge[at] += 1
    edge[at + window] -= 1
    return _per_text(np.cumsum(edge[:-1]) > 0, w.first)


def repeated_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = f"{COUNTS}, base_failed boolean, nearest_lang string, word_distance double, char_distance double, kept boolean"


class Judge:
    """Verdicts over texts; one object per task."""

    def __init__(self, model: list):
        self.reference = Reference(model)
        self.index = {name: k for k, name in enumerate(self.reference.langs)}
        self.white, self.fold, self.classes, self.hasher = is_white(), lower_table(), _classes(), Hasher(BASES[0])
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS.encode())] = True

    def verdicts(self, column: pa.Array, langs: pa.Array):
        """(i, j, the columns of VERDICT for the rows i to j) for slices of a batch."""
        reference, white, hasher = self.reference, self.white, self.hasher
        for i, j, w in pieces(column, white):
            texts = column.slice(i, j - i).to_pylist()
            n = w.counts()
            begin = w.data & 0xC0 != 0x80
            word_chars = _per_text(begin & ~white[w.data], w.offsets)
            again = repeated_words(w, hasher.grams(hasher.of_words(w), WINDOW), WINDOW)
            lines = np.array([repeated_lines(t) if t else 0 for t in texts], np.int64)
            failed = (n < FEWEST_WORDS) | (100 * again > MOST_REPEATED * n)
            chars = _char_histograms(w.data, w.offsets, self.classes)
            word_far, char_far, names = np.zeros(len(n)), np.zeros(len(n)), [None] * len(n)
            lacks = np.zeros(len(n), bool)
            if reference.langs:
                folded = Words(self.fold[w.data], w.offsets, white)
                named = np.array([self.index.get(x, -1) for x in langs.slice(i, j - i).to_pylist()], np.int64)
                word_far, char_far, best, lacks = reference.distances(folded, hasher.of_words(folded), chars, named)
                names = [reference.langs[k] if m else None for k, m in zip(best, n)]
            no_words = (n < LEAST_WORDS) | (not reference.langs)
            no_chars = (chars.sum(axis=1) < LEAST_CHARS) | (not reference.langs)
            kept = ~failed & (no_words | ((word_far <= FAR_WORDS) & ~lacks)) & (no_chars | (char_far <= FAR_CHARS))
            yield i, j, [pa.array(n), pa.array(word_chars), pa.array(_per_text(self.symbol[w.data], w.offsets)),
                         pa.array(lines), pa.array(again), pa.array(failed), pa.array(names, pa.string()),
                         pa.array(word_far, mask=no_words), pa.array(char_far, mask=no_chars), pa.array(kept)]


def judged(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """id column, base counts, base_failed, nearest_lang, word_distance, char_distance (null for texts too short for
    them) and kept, one row per input row."""
    require_columns(docs, id_column, text, lang)
    model = docs.sparkSession.sparkContext.broadcast(references(docs, text, lang).collect())
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        lean()
        judge = Judge(model.value)
        for batch in batches:
            for i, j, verdict in judge.verdicts(batch.column(1), batch.column(2)):
                yield pa.record_batch([batch.column(0).slice(i, j - i), *verdict],
                                      names=["id", *[c.split()[0] for c in VERDICT.split(", ")]])

    out = docs.select(field(id_column).alias("id"), field(text).alias("text"),
                      field(lang).cast("string").alias("lang")).mapInArrow(
        run, f"id {id_type}, {VERDICT}")
    return out.withColumnRenamed("id", id_column)


def without_rejected(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with all their columns. Every row is judged by itself: ids, also shared or missing
    ones, play no part, and nothing is shuffled but the counts of the references."""
    require_columns(docs, text, lang)
    model = docs.sparkSession.sparkContext.broadcast(references(docs, text, lang).collect())
    place = docs.columns.index(text)

    def run(batches):
        lean()
        judge = Judge(model.value)
        for batch in batches:
            kept = [verdict[-1] for *_, verdict in judge.verdicts(batch.column(place), batch.column(batch.num_columns - 1))]
            if kept:
                rows = batch.filter(pa.concat_arrays(kept))
                yield pa.record_batch(rows.columns[:-1], names=rows.schema.names[:-1])

    # Numbered, so that no two names can clash.
    rows = docs.select(*[field(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], field(lang).cast("string").alias("lang"))
    out = rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]]))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
