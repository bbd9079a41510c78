"""Phrases whose words stand together more often than their parts would, per language.

*Prefix-free parsing.* A piece of text is cut where its content says so: a window of three words whose hash is divisible by
``EVERY`` ends one chunk and starts the next, so chunks overlap by those three words and equal stretches of text fall into
equal chunks wherever they stand. The distinct chunks with their number of occurrences are the dictionary. Phrases of up to
four words are counted inside distinct chunks only, times the chunk's occurrences. A phrase belongs to the chunk in which it
starts before the overlap (the last chunk of a piece owns all its starts), so each is counted once.

*Counting* takes two passes over the dictionary. The first counts words and pairs. The second counts phrases of three and four
words, but only where each pair in them is frequent, since a phrase is never more frequent than its parts; a bitmap of fixed
size says which pairs may be. A task adds up equal phrases of ``SLICE`` words before it hands them on; keys are the phrases
themselves, so counts are exact.

*Definitions.* Texts are lower-cased in A-Z, split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
``[^\\x20\\x09]+``. A candidate has two to four words and a >= ``least`` occurrences, overlapping ones included. Cut after
its first k words it scores floor(2000000 a / (l + r)), l and r being the occurrences of its parts; the lowest cut
counts, the shortest first part among equal ones. A candidate goes when a longer one that contains it has 80 percent of
its occurrences or more. The first ``top`` of each language by score, occurrences (both falling) and phrase stay.

*Edge cases.* A missing text is empty, a missing language is ``und``. Without words or candidates there are no rows. Repeated
rows count each time. A piece without any cut is one chunk, however long. Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.columns import field
from patronage.llm.membership import _places, maybe_in
from patronage.llm.tokens import pair_hash
from patronage.llm.words import BASES, U64, Hasher, Words, bytes_of, is_white, lean, lower_table, slices
from patronage.scratch import stored

LEAST, TOP, CONTAINED = 30, 2000, 80
LONGEST = 4
OVERLAP = LONGEST - 1
EVERY = 32
# Bytes that end a piece, and those that part the words of a piece.
ENDS = list(b".,;:!?\n\x0b\f\r")
BLANKS = list(b" \t")
# Distinct chunks a task holds before it hands them on, and words it counts at once.
HELD, SLICE = 50_000, 1 << 17
# 2^26 bits: 8 MB in every task.
BITS = 26


def _table(values: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[values] = True
    return out


def _normal(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray, ends: np.ndarray):
    """Words of texts over bytes in which one blank follows each word; and the number of each word's piece."""
    words = Words(data, offsets, apart)
    piece = np.cumsum(ends[data])[words.starts] if len(words) else np.zeros(0, np.int64)
    length = words.ends - words.starts
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]]) if len(words) else np.zeros(0, np.int64)
    text = np.full(int((length + 1).sum()), 0x20, np.uint8)
    inside = np.ones(len(text), bool)
    inside[starts + length] = False
    taken = ~apart[data]
    text[inside] = data[taken]
    words.data, words.starts, words.ends = text, starts, starts + length
    return words, piece


def _cuts(words: Words, piece: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word after the last, and whether a chunk ends its piece."""
    n = len(words)
    opens = np.ones(n, bool)
    text = words.text_of_word()
    opens[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(opens)
    end_of = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    key = hasher.grams(hasher.of_words(words), OVERLAP)
    cut = (key % U64(EVERY) == U64(0)) & (np.arange(n) + OVERLAP <= end_of)
    starts = np.flatnonzero(opens | cut)
    last = np.append(opens[starts[1:]], True)
    return starts, np.where(last, end_of[starts], np.append(starts[1:], n) + OVERLAP), last


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, last, chunk, n): the distinct chunks of a language and how often the parse has them."""
    rows = docs.select(F.coalesce(field(lang), F.lit("und")).alias("lang"), field(text).alias("text"))

    def handed(held: dict) -> pa.RecordBatch:
        keys = [k for k in held if held[k]]
        sizes = [len(held[k]) for k in keys]
        return pa.record_batch([
            pa.array(np.repeat(np.array([k[0] for k in keys], object), sizes), pa.string()),
            pa.array(np.repeat([k[1] for k in keys], sizes), pa.bool_()),
            pa.array([c.decode() for k in keys for c in held[k]], pa.string()),
            pa.array([n for k in keys for n in held[k].values()], pa.int64()),
        ], names=["lang", "last", "chunk", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        ends, fold, hasher = _table(ENDS), lower_table(), Hasher(BASES[0])
        apart = _table(ENDS + BLANKS)
        held, distinct = {}, 0
        for batch in batches:
            data, offsets = bytes_of(batch.column(1))
            langs = batch.column(0).to_pylist()
            for i, j in slices(offsets):
                words, piece = _normal(fold[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], apart, ends)
                if not len(words):
                    continue
                starts, stops, last = _cuts(words, piece, hasher)
                body = words.data.tobytes()
                own = (np.searchsorted(words.first, starts, "right") - 1 + i).tolist()
                spans = zip(own, last.tolist(), words.starts[starts].tolist(), words.ends[stops - 1].tolist())
                for d, done, a, b in spans:
                    counts = held.setdefault((langs[d], done), {})
                    chunk = body[a:b]
                    counts[chunk] = counts.get(chunk, 0) + 1
                distinct = sum(map(len, held.values()))
                if distinct >= HELD:
                    yield handed(held)
                    held = {}
        if held:
            yield handed(held)

    parsed = rows.mapInArrow(run, "lang string, last boolean, chunk string, n long")
    return parsed.groupBy("lang", "last", "chunk").agg(F.sum("n").alias("n"))


class Counted:
    """The words of a slice of the dictionary as numbers, with the phrases that start at each of them."""

    def __init__(self, langs: pa.Array, last: np.ndarray, chunks: pa.Array, n: np.ndarray, blank: np.ndarray):
        data, offsets = bytes_of(chunks)
        self.words = w = Words(data, offsets, blank)
        self.times = np.repeat(n, w.counts())
        self.left = w.words_left()
        self.owned = np.repeat(last, w.counts()) | (self.left > OVERLAP)
        lengths = w.ends - w.starts
        inside = np.ascontiguousarray(data[~blank[data]])
        places = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        plain = pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(places), pa.py_buffer(inside)).dictionary_encode()
        spoken = langs.dictionary_encode()
        tongue = np.repeat(spoken.indices.to_numpy(), w.counts()).astype(np.int64)
        # A number for each word of each language.
        both, self.code = np.unique(tongue * len(plain.dictionary) + plain.indices.to_numpy(), return_inverse=True)
        self.text = plain.dictionary.take(pa.array(both % max(len(plain.dictionary), 1)))
        self.lang = spoken.dictionary.take(pa.array(both // max(len(plain.dictionary), 1)))
        self.tongue = tongue

    def phrases(self, k: int, at: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, n) of the phrases of k words that start at the places ``at``, equal ones added up."""
        key = self.code[at].astype(np.int64)
        for j in range(1, k):
            # Numbers of distinct prefixes keep the key below 2^63.
            if j > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.text) + self.code[at + j]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        begins = np.flatnonzero(new)
        total = np.add.reduceat(self.times[at][order], begins) if len(at) else np.zeros(0, np.int64)
        example = at[order[begins]]
        parts = [self.text.take(pa.array(self.code[example + j])) for j in range(k)]
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return pa.record_batch([self.lang.take(pa.array(self.code[example])).cast(pa.string()), phrase.cast(pa.string()),
                                pa.array(total, pa.int64())], names=["lang", "phrase", "n"])

    def starts(self, k: int) -> np.ndarray:
        return np.flatnonzero(self.owned & (self.left >= k))

    def pairs(self, hasher: Hasher) -> np.ndarray:
        """Hash of the pair that starts at each word, its language included."""
        plain = hasher.of_words(self.words)
        after = np.append(plain[1:], U64(0))
        return pair_hash(pair_hash(plain, after), _lang_hashes(self.lang, hasher)[self.code])


def _lang_hashes(langs: pa.Array, hasher: Hasher) -> np.ndarray:
    """Hash of whole texts, blanks and all."""
    data, offsets = bytes_of(langs)
    w = Words(data, offsets, np.zeros(256, bool))
    out = np.zeros(len(langs), U64)
    out[np.diff(w.first) > 0] = hasher.of_words(w)
    return out


def _sliced(batches: Iterator[pa.RecordBatch], blank: np.ndarray) -> Iterator[Counted]:
    """Slices of about ``SLICE`` words of the dictionary."""
    held, size = [], 0
    for batch in batches:
        data, offsets = bytes_of(batch.column(2))
        for i, j in slices(offsets):
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
            if size >= 6 * SLICE:
                yield _counted(held, blank)
                held, size = [], 0
    if held:
        yield _counted(held, blank)


def _counted(held: list[pa.RecordBatch], blank: np.ndarray) -> Counted:
    t = pa.Table.from_batches(held).combine_chunks()
    return Counted(t["lang"].combine_chunks(), t["last"].to_numpy(), t["chunk"].combine_chunks(), t["n"].to_numpy(), blank)


def _short(parse: DataFrame) -> DataFrame:
    """(lang, phrase, n) of words and pairs; the phrase '' has the number of all words."""
    def run(batches):
        lean()
        for c in _sliced(batches, _table(BLANKS)):
            for k in (1, 2):
                yield c.phrases(k, c.starts(k))
            at = c.starts(1)
            total = np.zeros(len(c.lang), np.int64)
            np.add.at(total, c.code[at], c.times[at])
            spoken = pa.table({"lang": c.lang.cast(pa.string()), "n": total}).group_by("lang").aggregate([("n", "sum")])
            yield pa.record_batch([spoken["lang"].combine_chunks(), pa.array([""] * len(spoken), pa.string()),
                                   spoken["n_sum"].combine_chunks()], names=["lang", "phrase", "n"])

    return parse.mapInArrow(run, "lang string, phrase string, n long")


def _long(parse: DataFrame, sent) -> DataFrame:
    """(lang, phrase, n) of phrases of three and four words all of whose pairs may be frequent."""
    def run(batches):
        lean()
        hasher = Hasher(BASES[0])
        for c in _sliced(batches, _table(BLANKS)):
            frequent = np.zeros(len(c.code) + LONGEST, bool)
            frequent[maybe_in(sent.value, c.pairs(hasher), BITS)] = True
            for k in range(3, LONGEST + 1):
                at = c.starts(k)
                for j in range(k - 1):
                    at = at[frequent[at + j]]
                yield c.phrases(k, at)

    return parse.mapInArrow(run, "lang string, phrase string, n long")


def _pair_bitmap(pairs: DataFrame) -> np.ndarray:
    """Bitmap of the pairs (lang, phrase); at most 2^(BITS - 6) rows reach the driver."""
    def run(batches):
        lean()
        blank, hasher = _table(BLANKS), Hasher(BASES[0])
        for batch in batches:
            one = np.ones(batch.num_rows, np.int64)
            c = Counted(batch.column(0), one.astype(bool), batch.column(1), one, blank)
            keys = c.pairs(hasher)[c.starts(2)]
            places = np.concatenate(_places(keys, BITS))
            at, own = np.unique(places >> U64(6), return_inverse=True)
            mask = np.zeros(len(at), U64)
            np.bitwise_or.at(mask, own, U64(1) << (places & U64(63)))
            yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    found = pairs.select("lang", "phrase").mapInArrow(run, "word long, mask long").groupBy("word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(U64)


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, n) of phrases of one to four words that occur ``least`` times or more; phrase '' counts all words."""
    spark = docs.sparkSession
    parse = stored(dictionary(docs, text, lang), "chunks")

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))

    short = stored(summed(_short(parse)), "short-phrases")
    sent = spark.sparkContext.broadcast(_pair_bitmap(short.where(F.instr("phrase", " ") > 0)))
    long = stored(summed(_long(parse, sent)), "long-phrases")
    sent.unpersist()
    return short.unionByName(long)


def _joined(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    counted = frequent_phrases(docs, least, text, lang)
    total = counted.where(F.col("phrase") == "").select("lang", F.col("n").alias("total"))
    found = counted.where((F.col("phrase") != "") & (F.col("n") >= least))
    words = F.split("phrase", " ")
    candidates = found.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))

    inner = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(F.flatten(
        F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(
            F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: _joined(F.col("words"), i, k)))))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED * F.col("a")))

    cuts = left.select("lang", "phrase", "a", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
            k.alias("k"), _joined(F.col("words"), 1, k).alias("head"),
            _joined(F.col("words"), k + 1, F.size("words") - k).alias("rest")))).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = found.select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(
        parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # Numbers of up to 38 digits: the product may pass 64 bits.
    exact = F.expr("(cast(a as decimal(25, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    best = cuts.withColumn("score", exact.cast("long")).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
