"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Method. Every word (a run without white space, as it stands) of the trusted texts is in the model, known by its 64-bit hash.
Trigrams are counted in tasks and summed over tasks in shards, ranges of the hash of the words that part them: by the first
two for occurrences and contexts, by the last two for the different words before a bigram. Context totals, continuation counts
and the counts of counts that give the three discounts of each order are sums over the shards. Nothing is pruned and the
model grows with the trusted texts; after every context the probabilities of all words, and of one that stands for any word
never seen, add up to one.

Texts are scored in slices of at most about ``SLICE`` words. A slice asks each shard for its distinct n-grams, all of them, as
one row of sorted keys, and gets their counts back in the same order, so a frequent n-gram is one key per slice. Shards are as
many as the texts need: ``SHARD`` bytes of text each.

Disk. Shards are counted in ``PASSES`` parts, texts scored in ``PARTS`` and each asks ``RANGES`` parts of the model, one after the
other; what a part shuffled and stored goes when it has ended. The numbers of parts are fixed, so work and disk grow with the
input, and results do not depend on them.

A text's perplexity is 2^(mean bits per word). Thresholds are a quantile, per language, of the perplexities of trusted texts
that the model has not learned from: a quarter of them, chosen by the hash of the id. They are exact to 1/1000 bit.

Edge cases. Null and blank texts have no perplexity and are not kept; texts of 1 to ``LEAST_WORDS`` - 1 words are kept. Languages without held-out trusted text, and texts
without a language, get the threshold over all languages. Without trusted text there is no model: perplexities and
thresholds are null and every text with words is kept. Ids with several labels are trusted if one says so; rows without
an id are scored and never learned from. Repeated rows score alike; other columns are ignored.
The texts are read once per part, so ``docs`` must give the same rows each time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.llm.ids import require_whole_ids
from patronage.llm.membership import only
from patronage.llm.tokens import before, pair_hash
from patronage.llm.words import BASES, U64, Hasher, as_long, is_white, lean, pieces
from patronage.scratch import discard, stored, stored_apart, tidy

QUANTILE = 0.995
# Texts with fewer words say too little: they set no threshold and stay.
LEAST_WORDS = 20
HELD = 1 << 20
# Stands for the words before a text.
OPEN = U64(0x51ED270B7A3F9E15)
OPENING = pair_hash(np.array([OPEN]), np.array([OPEN]))
# Words of a slice, bytes of text for each shard of the model, and the least and largest number of shards.
SLICE, SHARD, SHARDS = 1 << 19, 1 << 23, (36, 1 << 16)
# Parts in which the model is counted, in which texts are scored, and of the model that they ask one after the other.
PASSES, PARTS, RANGES = 6, 8, 2
# Bits of a trigram's key that it shares with its context, so that both are in one shard.
SHARED = U64(0xFFFF << 48)


def held_out(id_column: Column) -> Column:
    """The quarter of the trusted texts that sets the thresholds."""
    return F.pmod(F.xxhash64(id_column), F.lit(4)) == 0


def _discounts(df: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of n-grams seen once, twice, three times or more."""
    n = {r["n"]: r["c"] for r in df.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
    return _discounted(*(n.get(k, 0) for k in (1, 2, 3, 4)))


def _discounted(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), found)]


def _pairs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word's bigram, and of the bigram before it."""
    pairs = pair_hash(before(hashes, first, OPEN), hashes)
    return pairs, before(pairs, first, OPENING[0])


def _gram(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a pair of words and a third."""
    return (pair & SHARED) | (pair_hash(pair, word) >> U64(16))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key; never falls as keys grow."""
    return ((keys >> U64(48)) * U64(shards) >> U64(16)).astype(np.int64)


def _inside(keys: np.ndarray, shards: int, lo: int, hi: int) -> np.ndarray:
    """Whether each key is in one of the shards from lo to hi - 1."""
    least, end = (-(-(x << 16) // shards) for x in (lo, hi))
    inside = keys >= U64(least << 48)
    return inside if end >= 1 << 16 else inside & (keys < U64(end << 48))


def _cut(keys: np.ndarray, shards: int, lo: int, hi: int) -> Iterator[tuple[int, slice]]:
    """(shard, its part of the sorted keys) for the shards from lo to hi - 1 that have keys."""
    ends = np.searchsorted(_shard(keys, shards), np.arange(lo, hi + 1))
    return ((lo + k, slice(i, j)) for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as bytes: the first, then the steps, lowest bytes of all first and those that are always 0 left out."""
    steps = np.diff(keys)
    size = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    return keys[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8).T[:size].tobytes() + len(keys).to_bytes(8, "little")


def _keys_in(packed: bytes) -> np.ndarray:
    many = int.from_bytes(packed[-8:], "little")
    if not many:
        return np.zeros(0, U64)
    steps = np.zeros((many, 8), np.uint8)
    steps[0] = np.frombuffer(packed, np.uint8, 8)
    if many > 1:
        rows = np.frombuffer(packed, np.uint8)[8:-8].reshape(-1, many - 1)
        steps[1:, :len(rows)] = rows.T
    return np.cumsum(steps.view(U64)[:, 0], dtype=U64)


def _numbers(*columns: np.ndarray) -> bytes:
    """Columns of as many whole numbers, each in the smallest type that holds them."""
    out = []
    for c in columns:
        kind = np.min_scalar_type(int(c.max()) if len(c) else 0)
        out += [bytes([kind.itemsize]), c.astype(kind).tobytes()]
    return b"".join(out)


def _columns_in(numbers: bytes, many: int) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(numbers):
        size = numbers[at]
        out.append(np.frombuffer(numbers, f"u{size}", many, at + 1).astype(np.int64))
        at += 1 + size * many
    return out


def _sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and, for each, the sums of the columns and the place of one of its rows."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order], new) if len(new) else np.zeros(0, np.int64) for c in columns]
    return keys[new], *sums, order[new]


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _levels(n: np.ndarray) -> list[np.ndarray]:
    """n, and whether it is 1, 2, or more: summed, what a context needs to know of all that follows it."""
    return [n, *[x.astype(np.int64) for x in (n == 1, n == 2, n > 2)]]


def _seen(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, how many there are, and their sum."""
    return [*[int((n == k).sum()) for k in (1, 2, 3, 4)], int((n > 0).sum()), int(n.sum())]


def shards_for(texts: DataFrame) -> int:
    """Shards that a model needs if ``texts`` (a column text) are learned or scored."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    return min(max(-(-size // SHARD), SHARDS[0]), SHARDS[1])


def counted_triples(texts: DataFrame, shards: int, lo: int, hi: int) -> DataFrame:
    """shard, after, keys, left, right: distinct trigrams of ``text`` in a task, for the shards from lo to hi - 1. Rows with
    ``after`` are by the first two words: keys of the trigrams, of those two words, and occurrences. The others are by the last
    two words: keys of the trigrams, and hashes of those two words."""
    names = ["shard", "after", "keys", "left", "right"]

    def row(shard, after, keys, left, right):
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([after]), *[pa.array([x], pa.binary()) for x in (
            _packed(keys), left.tobytes(), right)]], names=names)

    def summed(held):
        second, last, this, pair, context = [np.concatenate(c) for c in zip(*held)]
        at = np.flatnonzero(_inside(context, shards, lo, hi))
        context = context[at]
        keys, n, one = _sums(_gram(context, this[at]), np.ones(len(at), np.int64))
        for shard, own in _cut(keys, shards, lo, hi):
            yield row(shard, True, keys[own], context[one[own]], _numbers(n[own]))
        at = np.flatnonzero(_inside(pair, shards, lo, hi))
        keys, one = _sums(_gram(pair[at], second[at]))
        one = at[one]
        for shard, own in _cut(keys, shards, lo, hi):
            yield row(shard, False, keys[own], last[one[own]], this[one[own]].tobytes())

    def run(batches):
        lean()
        white, hasher = is_white(), Hasher(BASES[0])
        held, size = [], 0
        for batch in batches:
            for *_, w in pieces(batch.column(0), white):
                hashes = hasher.of_words(w)
                last = before(hashes, w.first, OPEN)
                held.append((before(last, w.first, OPEN), last, hashes, *_pairs(hashes, w.first)))
                size += len(hashes)
                if size >= HELD:
                    yield from summed(held)
                    held, size = [], 0
        if size:
            yield from summed(held)

    return texts.select("text").mapInArrow(run, "shard int, after boolean, keys binary, left binary, right binary")


MODEL = "shard int, words int, keys binary, counts binary, seen array<long>"


def _model_rows(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "words", "keys", "counts", "seen"])


def _of_shard(shards: int):
    """The rows of a shard from those that ``counted_triples`` has for it."""
    def joined(parts, kind=U64):
        return np.concatenate([np.zeros(0, kind), *parts])

    def run(key, found):
        lean()
        own = key[0].as_py()
        after, *rest = [found[c].to_pylist() for c in ("after", "keys", "left", "right")]
        rows = list(zip(after, *rest))
        known = [(_keys_in(k), np.frombuffer(left, U64), right) for is_after, k, left, right in rows if is_after]
        triples, n, one = _sums(joined([k for k, *_ in known]), joined([_columns_in(r, len(k))[0] for k, _, r in known], np.int64))
        contexts, *after_them, _ = _sums(joined([c for _, c, _ in known])[one], *_levels(n))
        known = [(_keys_in(k), np.frombuffer(left, U64), np.frombuffer(right, U64)) for is_after, k, left, right in rows if not is_after]
        _, one = _sums(joined([k for k, *_ in known]))
        last, this = (joined([x[c] for x in known])[one] for c in (1, 2))
        pairs, n_pairs, one = _sums(pair_hash(last, this), np.ones(len(one), np.int64))
        last, this = last[one], this[one]
        # Bigrams and contexts of two words have the same keys, words and contexts of one word too.
        none, nothing = np.zeros(len(contexts), np.int64), np.zeros(len(pairs), np.int64)
        keys, *of_pairs, _ = _sums(np.append(pairs, contexts), np.append(n_pairs, none),
                                   *[np.append(nothing, x) for x in after_them])
        words, *of_words, _ = _sums(np.append(this, last), np.append(nothing + 1, nothing),
                                    *[np.append(nothing, x) for x in _levels(n_pairs)])
        out = [(own, 3, _packed(triples), _numbers(n), _seen(n)), (own, 2, _packed(keys), _numbers(*of_pairs), _seen(n_pairs))]
        return _model_rows(out + [(k, 1, _packed(words[at]), _numbers(*[x[at] for x in of_words]), None)
                                  for k, at in _cut(words, shards, 0, shards)])

    return run


def _of_words(key, found):
    """The words of a shard from what all shards of bigrams have of them."""
    lean()
    keys = [_keys_in(k) for k in found["keys"].to_pylist()]
    columns = zip(*[_columns_in(c, len(k)) for c, k in zip(found["counts"].to_pylist(), keys)])
    words, *sums, _ = _sums(np.concatenate(keys), *[np.concatenate(c) for c in columns])
    return _model_rows([(key[0].as_py(), 1, _packed(words), _numbers(*sums), _seen(sums[0]))])


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def counted_model(texts: DataFrame, shards: int | None = None) -> dict | None:
    """The whole model of ``texts`` (a column text), or None if they hold no words.

    ``parts`` are tables of n-grams of three and two words, for ranges of the ``shards``, and ``words`` is that of words. A row has
    some of a shard, by the number of words: sorted keys and their counts. These are n (occurrences, or different words
    before it for bigrams and words), and for up to two words, as a context: the total of n over what follows, and how often
    that n is 1, 2, or more. ``discounts`` are those of words, bigrams and trigrams, ``total`` and ``size`` the sum of n
    over words and their number, ``left`` what the words' discounts leave.
    """
    shards = shards or shards_for(texts)
    with tidy(texts.sparkSession):
        parts, words = [], []
        for k in range(PASSES):
            lo, hi = (shards * x // PASSES for x in (k, k + 1))
            found = stored_apart(counted_triples(texts, shards, lo, hi).groupBy("shard").applyInArrow(_of_shard(shards), MODEL),
                                 "ngrams", "words", [1, 2, 3])
            words.append(found[0])
            parts.append(_union(found[1:]))
        of_shards, words = words, stored(_union(words).select("shard", "keys", "counts").groupBy("shard").applyInArrow(
            _of_words, MODEL), "words")
        for table in of_shards:
            discard(table)
        sums = {r["words"]: r["seen"] for r in _union([*parts, words]).groupBy("words").agg(
            F.array(*[F.sum(F.col("seen")[k]) for k in range(6)]).alias("seen")).collect()}
    if 1 not in sums:
        return None
    d1, d2, d3 = (_discounted(*sums[k][:4]) for k in (1, 2, 3))
    once, twice, *_, size, total = sums[1]
    return {"parts": parts, "words": words, "shards": shards, "discounts": (d1, d2, d3), "total": total, "size": size,
            "left": d1[0] * once + d1[1] * twice + d1[2] * (size - once - twice)}


def forget(model: dict) -> None:
    """Removes the tables of a model that is no longer needed."""
    for table in (*model["parts"], model["words"]):
        discard(table)


def counted_bits(triples: np.ndarray, pairs: np.ndarray, words: np.ndarray, first: np.ndarray, open_pair: int, open_word: int,
                 found: list[list[np.ndarray]], numbers: dict) -> np.ndarray:
    """Bits of each word. Its trigram, bigram and itself are places in the counts ``found`` for one, two and three words."""
    d1, d2, d3 = numbers["discounts"]
    (n_words, *after_words), (n_pairs, *after_pairs), (n_triples,) = found

    def kept(n, d):
        return n - np.select([n == 0, n == 1, n == 2], [0, d[0], d[1]], d[2])

    p = ((kept(n_words, d1) + numbers["left"] / (numbers["size"] + 1)) / numbers["total"])[words]
    for n, at, (total, once, twice, more), context, d in (
            (n_pairs, pairs, after_words, before(words, first, open_word), d2),
            (n_triples, triples, after_pairs, before(pairs, first, open_pair), d3)):
        some = np.maximum(total, 1)
        rest = np.where(total > 0, (d[0] * once + d[1] * twice + d[2] * more) / some, 1.0)
        p = kept(n, d)[at] / some[context] + rest[context] * p
    return -np.log2(p)


def _sliced(docs: DataFrame, columns: list[str]) -> DataFrame:
    """slice, the named columns as lists, counts of words, distinct word hashes, and each word's place among them."""
    kinds = dict(docs.dtypes)

    def row(held):
        words, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        lists = []
        for k in range(len(columns)):
            values = pa.concat_arrays([h[2][k] for h in held])
            lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        counts = np.concatenate([h[1] for h in held]).astype(np.int64)
        packed = [pa.array([x.tobytes()], pa.binary()) for x in (counts, words, at.astype(np.int32))]
        return pa.record_batch([pa.array([uuid.uuid4().int >> 65], pa.int64()), *lists, *packed],
                               names=["slice", *columns, "counts", "words", "at"])

    def run(batches):
        lean()
        white, hasher = is_white(), Hasher(BASES[0])
        held, size = [], 0
        for batch in batches:
            for i, j, w in pieces(batch.column(len(columns)), white):
                held.append((hasher.of_words(w), w.counts(), [batch.column(k).slice(i, j - i) for k in range(len(columns))]))
                size += len(w) + j - i
                if size >= SLICE:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    lists = ", ".join(f"`{c}` array<{kinds[c]}>" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"slice long, {lists}, counts binary, words binary, at binary")


def _unpacked(counts: bytes, words: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words, and the first word of each text."""
    first = np.append(0, np.cumsum(np.frombuffer(counts, np.int64)))
    return np.frombuffer(words, U64)[np.frombuffer(at, np.int32)], first


def _asked(slices: DataFrame, shards: int, lo: int, hi: int) -> DataFrame:
    """slice, shard, one, two, three: distinct words, bigrams and trigrams of each slice, sorted, for the shards from lo to hi - 1."""
    names = ["one", "two", "three"]

    def run(batches):
        lean()
        for batch in batches:
            for k in range(batch.num_rows):
                name, counts, words, at = (c[k].as_py() for c in batch.columns)
                hashes, first = _unpacked(counts, words, at)
                pairs, contexts = _pairs(hashes, first)
                inside = _inside(contexts, shards, lo, hi)
                triples, rows = _gram(contexts[inside], hashes[inside]), {}
                for order, keys in zip(names, (np.append(np.frombuffer(words, U64), OPEN), np.append(pairs, OPENING), triples)):
                    keys = _distinct(keys[_inside(keys, shards, lo, hi)] if order != "three" else keys)
                    for shard, part in _cut(keys, shards, lo, hi):
                        rows.setdefault(shard, {})[order] = _packed(keys[part])
                nothing = _packed(np.zeros(0, U64))
                yield pa.record_batch([pa.array([name] * len(rows), pa.int64()), pa.array(list(rows), pa.int32()),
                                       *[pa.array([r.get(order, nothing) for r in rows.values()], pa.binary()) for order in names]],
                                      names=["slice", "shard", *names])

    return slices.select("slice", "counts", "words", "at").mapInArrow(
        run, "slice long, shard int, one binary, two binary, three binary")


def _answered(asked: pa.Table, known: pa.Table) -> pa.Table:
    """slice, shard, one, two, three: the counts of the keys that each slice asks a shard for, in their order; 0 if it has none."""
    lean()
    names = ["one", "two", "three"]
    out = [asked["slice"], asked["shard"]]
    for k, order in enumerate(names, 1):
        rows = known.filter(pc.equal(known["words"], k))
        tables = [(_keys_in(keys), counts) for keys, counts in zip(rows["keys"].to_pylist(), rows["counts"].to_pylist())]
        keys, counts = tables[0] if tables else (np.zeros(0, U64), b"")
        columns = [np.append(c, 0) for c in _columns_in(counts, len(keys))] or [np.zeros(1, np.int64)] * (1 if k == 3 else 5)
        ends = np.append(keys, U64(0))
        answers = []
        for packed in asked[order]:
            wanted = _keys_in(packed.as_py())
            at = np.searchsorted(keys, wanted)
            at = np.where(ends[at] == wanted, at, len(keys))
            answers.append(_numbers(*[c[at] for c in columns]))
        out.append(pa.array(answers, pa.binary()))
    return pa.table(out, names=["slice", "shard", *names])


def _scored(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    kinds = dict(docs.dtypes)
    # Written: a slice's name must be the same wherever it is read.
    slices = stored(_sliced(docs, columns), "slices")
    numbers = {k: v for k, v in model.items() if k not in ("parts", "words")}
    shards, answers = model["shards"], []
    for k in range(RANGES):
        first, end = (PASSES * x // RANGES for x in (k, k + 1))
        lo, hi = (shards * x // PASSES for x in (first, end))
        known = _union([*model["parts"][first:end], model["words"].where(F.col("shard").between(lo, hi - 1))]).drop("seen")
        answers.append(stored(_asked(slices, shards, lo, hi).groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(
            _answered, "slice long, shard int, one binary, two binary, three binary"), "answers"))

    def bits_of(slices_, found):
        lean()
        found = found.sort_by("shard")
        out = []
        for k in range(slices_.num_rows):
            packed = [slices_[c][k].as_py() for c in ("counts", "words", "at")]
            hashes, first = _unpacked(*packed)
            n = np.diff(first)
            pairs, contexts = _pairs(hashes, first)
            triples, at_triple = np.unique(_gram(contexts, hashes), return_inverse=True)
            pairs, at_pair = np.unique(np.append(pairs, OPENING), return_inverse=True)
            own = np.frombuffer(packed[1], U64)
            words = _distinct(np.append(own, OPEN))
            at_word = np.searchsorted(words, own)[np.frombuffer(packed[2], np.int32)]
            counts = []
            for order, keys, many in (("one", words, 5), ("two", pairs, 5), ("three", triples, 1)):
                parts = dict(zip(found["shard"].to_pylist(), found[order].to_pylist()))
                columns_ = [_columns_in(parts[s], at.stop - at.start) for s, at in _cut(keys, shards, 0, shards)]
                counts.append([np.concatenate(c) for c in zip(*columns_)] or [np.zeros(0, np.int64)] * many)
            bits = counted_bits(at_triple, at_pair[:-1], at_word, first, at_pair[-1], int(np.searchsorted(words, OPEN)), counts, numbers)
            # Each text is summed by itself: what stands before it in the slice must not change its rounding.
            sums = np.zeros(len(n))
            sums[n > 0] = np.add.reduceat(bits, first[:-1][n > 0]) if len(bits) else 0
            out.append(pa.table([*[slices_[c][k].values for c in columns], pa.array(n),
                                 pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0)],
                                names=[*columns, "n_words", "mean_bits"]))
        return pa.concat_tables(out)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    scored = stored(slices.groupBy("slice").cogroup(_union(answers).groupBy("slice")).applyInArrow(
        bits_of, f"{schema}, n_words long, mean_bits double"), "perplexities")
    for table in (slices, *answers):
        discard(table)
    return scored


def perplexities(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """The named columns, n_words and mean_bits (null without words) of every row; the text is the column ``text``."""
    part = F.pmod(F.xxhash64(*columns, "text"), F.lit(PARTS))
    with tidy(docs.sparkSession):
        return _union([_scored(docs.where(part == k), model, columns) for k in range(PARTS)])


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
           label: str = "quality", quantile: float = QUANTILE) -> DataFrame:
    """id column, n_words, perplexity, threshold and kept of every row of ``docs``; trusted texts have ``label`` 1."""
    require_whole_ids(docs, id_column)
    require_whole_ids(labels, id_column)
    require_columns(docs, text, lang)
    require_columns(labels, label)
    named = docs.select(field(id_column).alias("id"), field(text).alias("text"),
                        field(lang).cast("string").alias("lang"))
    trusted = labels.where(field(label) == 1).select(field(id_column).cast("long").alias("id")).where(
        "id is not null").distinct()
    learned = trusted.where(~held_out(F.col("id")))
    with tidy(docs.sparkSession):
        texts = stored(only(named.select(F.col("id").cast("long").alias("id"), "text"), learned).join(learned, "id").select("text"), "trusted")
    model = counted_model(texts, shards_for(named))
    discard(texts)
    if model is None:
        words = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+', 0)")).cast("long")
        none = F.lit(None).cast("double")
        return named.select(F.col("id").alias(id_column), words.alias("n_words"), none.alias("perplexity"),
                            none.alias("threshold"), (words > 0).alias("kept"))
    scored = perplexities(named, model, ["id", "lang"])
    forget(model)
    test = scored.where(held_out(F.col("id").cast("long"))).join(
        trusted.select(F.col("id").alias("trusted_id")), F.col("id").cast("long") == F.col("trusted_id")).where(
        F.col("n_words") >= LEAST_WORDS).select("lang", F.round("mean_bits", 3).alias("b"))
    limit = F.percentile("b", F.lit(float(quantile))) + 0.001
    limits = test.where("lang is not null").groupBy("lang").agg(limit.alias("own"))
    overall = test.agg(limit.alias("o")).first()["o"]
    out = scored.join(limits, "lang", "left").withColumn("bound", F.coalesce("own", F.lit(overall).cast("double")))
    short = F.col("n_words").between(1, LEAST_WORDS - 1)
    kept = F.col("mean_bits").isNotNull() & (short | F.coalesce(F.col("mean_bits") <= F.col("bound"), F.lit(True)))
    return out.select(F.col("id").alias(id_column), "n_words",
                      F.round(F.pow(F.lit(2.0), "mean_bits"), 6).alias("perplexity"),
                      F.round(F.pow(F.lit(2.0), "bound"), 6).alias("threshold"), kept.alias("kept"))
