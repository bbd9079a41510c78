"""Benchmark decontamination: documents that contain most of a test item.

An item is contained in a document if at least ``percent`` of the item's distinct five-word shingles (A-Z lower-cased)
are among the document's.

Method. Containment of a short set in a long one makes a tiny Jaccard similarity, so both sides are partitioned by size.
Items fall into classes by their number of shingles, up to 4, 8, 16, 32 and so on. Items of up to ``EXACT`` shingles, a
class of their own, are searched by the shingles themselves: a document is a candidate if it holds enough of them, which
misses nothing. For a class of up to u shingles, documents are cut into segments of 2u, and every segment and every item
gets ``SAMPLES`` MinHash values. A document is a candidate for an item if one of its segments shares one value with it. An
item of the class has more than u / 2 shingles, so wherever in the document they stand, the segments' similarities to the
item add up to 0.15 at least, and all 64 values miss with probability e^-9.6 or less; for shingles that stand together
e^-12. Minima of long segments come from those of short ones; the samples are computed once for all classes.

Candidates are verified by exact shingle containment in the whole document.

What is sent to all tasks is a bitmap of fixed size over the items' (class, sample, value) keys. It spares the shuffle the
keys that no item has; the join that follows is exact. Items are never gathered anywhere.

Edge cases. Items and documents without words or text match nothing. An item or a document of one to four words is one
shingle, its whole sequence, and a match needs that same sequence. Items that share an id are one item for the result, but
each text is searched for on its own. Rows without an id take no part, and documents without one are kept. Empty tables
give empty results; extra columns are passed through by ``without_leaks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.llm.ids import fresh, require_whole_ids
from patronage.llm.membership import BITS, key_bitmap, maybe_in
from patronage.llm.near_dedup import MinHasher, shingle_sets
from patronage.llm.words import BASES, U64, Hasher, as_long, is_white, lean, lower_table, mixed, pieces
from patronage.scratch import stored

SHINGLE = 5
PERCENT = 75
SAMPLES = 64
EXACT = 4  # shingles up to which items are searched by each of them: the first class
SMALLEST = 2 * EXACT  # shingles up to which items are of the first class with samples
# Shingles of a text whose samples are computed at once.
STRETCH = 1 << 12


def _keys(level: np.ndarray | int, values: np.ndarray) -> np.ndarray:
    """(segments, samples) of values to 64-bit keys of class, sample and value."""
    place = (np.arange(values.shape[1], dtype=U64) << U64(32)) | (U64(level) << U64(48))
    return mixed(values.astype(U64) + place)


def _level(n: int) -> int:
    """0 for up to 4 shingles, 1 for up to 8, 2 for up to 16, ..."""
    return max(0, int(n - 1).bit_length() - (EXACT - 1).bit_length())


def _exact(grams: np.ndarray) -> np.ndarray:
    """Keys of single shingles."""
    return mixed(grams ^ U64(BASES[1]))


def item_keys(items: DataFrame) -> DataFrame:
    """item, text_id, level, keys of every item text with words. ``items``: id, text."""
    def run(batches):
        lean()
        white, fold, hasher, minhash = is_white(), lower_table(), Hasher(BASES[0]), MinHasher(SAMPLES)
        for batch in batches:
            for i, j, w in pieces(batch.column(2), white, fold):
                rows = []
                for t, members in enumerate(shingle_sets(w, hasher, SHINGLE), i):
                    if len(members):
                        level = _level(len(members))
                        keys = _keys(level, minhash.samples(members)[None, :])[0] if level else _exact(members)
                        rows.append((batch.column(0)[t], batch.column(1)[t], level, keys.view(np.int64)))
                if rows:
                    item, own, level, keys = zip(*rows)
                    yield pa.record_batch([pa.array([x.as_py() for x in item], pa.int64()),
                                           pa.array([x.as_py() for x in own], pa.int64()), pa.array(level, pa.int32()),
                                           pa.array([k.tolist() for k in keys], pa.list_(pa.int64()))],
                                          names=["item", "text_id", "level", "keys"])

    return items.mapInArrow(run, "item long, text_id long, level int, keys array<long>")


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap over all item keys: every task fills its own, and they are merged word by word."""
    def run(batches):
        lean()
        filled = np.zeros(1 << (bits - 6), U64)
        for batch in batches:
            filled |= key_bitmap(batch.column(0).to_numpy().view(U64), bits)
        at = np.flatnonzero(filled)
        yield pa.record_batch([pa.array(at), as_long(filled[at])], names=["word", "mask"])

    words = keys.select(F.explode("keys").alias("key")).mapInArrow(run, "word long, mask long").groupBy("word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(U64)


def segment_minima(grams: np.ndarray, minhash: MinHasher, levels: list[int]):
    """(level, minima of its segments as a (segments, samples) array) for a text's shingles in order; levels from 1."""
    x = (grams >> U64(32)).astype(np.uint32)
    low = min([*levels, 4])
    short = SMALLEST << low
    parts = []
    for i in range(0, len(x), STRETCH):
        piece = x[i:i + STRETCH]
        if len(piece) % short:
            piece = np.append(piece, np.full(-len(piece) % short, piece[-1]))
        values = piece * minhash.factor
        values += minhash.shift
        parts.append(values.reshape(len(minhash.factor), -1, short).min(axis=2))
    lows = parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)
    for level in range(low, max(levels) + 1):
        if level > low:
            if lows.shape[1] % 2:
                lows = np.append(lows, lows[:, -1:], axis=1)
            lows = np.minimum(lows[:, ::2], lows[:, 1::2])
        if level in levels:
            yield level, lows.T


def suspects(docs: DataFrame, filled: np.ndarray, levels: list[int], bits: int) -> DataFrame:
    """id, text, keys of the documents with a value that may be an item's."""
    sent = docs.sparkSession.sparkContext.broadcast(filled)
    sampled = [level for level in levels if level]

    def run(batches):
        lean()
        white, fold, hasher, minhash = is_white(), lower_table(), Hasher(BASES[0]), MinHasher(SAMPLES)
        filter_ = sent.value
        for batch in batches:
            for i, j, w in pieces(batch.column(1), white, fold):
                grams = hasher.grams(hasher.of_words(w), SHINGLE)
                counts = w.counts()
                short = hasher.sequences(hasher.of_words(w), w.first[:-1], w.first[1:]) if counts.min() < SHINGLE else None
                rows, found = [], []
                for t, n in enumerate(counts):
                    if not n:
                        continue
                    own = grams[w.first[t]:w.first[t + 1] - SHINGLE + 1] if n >= SHINGLE else short[t:t + 1]
                    parts = [_exact(own)] if 0 in levels else []
                    if sampled:
                        parts += [_keys(level, values).ravel() for level, values in segment_minima(own, minhash, sampled)]
                    keys = np.concatenate(parts)
                    hit = maybe_in(filter_, keys, bits)
                    if len(hit):
                        rows.append(i + t)
                        found.append(np.unique(keys[hit]).view(np.int64).tolist())
                if rows:
                    take = pa.array(rows)
                    yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take),
                                           pa.array(found, pa.list_(pa.int64()))], names=["id", "text", "keys"])

    return docs.mapInArrow(run, "id long, text string, keys array<long>")


def _contained(pairs: DataFrame, percent: int) -> DataFrame:
    """id, item, n_item_shingles, n_shared of the pairs (id, text, item, item_text) that reach the threshold."""
    def run(batches):
        lean()
        white, fold, hasher = is_white(), lower_table(), Hasher(BASES[0])
        for batch in batches:
            sets = [[s for *_, w in pieces(batch.column(k), white, fold) for s in shingle_sets(w, hasher, SHINGLE)]
                    for k in (1, 3)]
            rows = []
            for t, (whole, item) in enumerate(zip(*sets)):
                place = np.minimum(np.searchsorted(whole, item), len(whole) - 1)
                both = int((whole[place] == item).sum()) if len(whole) else 0
                if len(item) and 100 * both >= percent * len(item):
                    rows.append((t, len(item), both))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([batch.column(0).take(take), batch.column(2).take(take),
                                   pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                                  names=["id", "item", "n_item_shingles", "n_shared"])

    return pairs.mapInArrow(run, "id long, item long, n_item_shingles long, n_shared long")


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id",
          item_text: str = "text", percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """One row per document and item it contains: id column, item column, n_item_shingles, n_shared.

    ``bits`` sets the size of the bitmap sent to the tasks: 2^bits bits. Raise it with the number of items.
    """
    require_whole_ids(docs, id_column)
    require_columns(docs, text)
    require_whole_ids(items, item_column)
    require_columns(items, item_text)
    named = docs.select(field(id_column).cast("long").alias("id"), field(text).alias("text")).where(
        "id is not null and text is not null")
    tests = items.select(field(item_column).cast("long").alias("item"), field(item_text).alias("item_text")).where(
        "item is not null and item_text is not null").distinct().withColumn("text_id", F.xxhash64("item", "item_text"))
    keys = stored(item_keys(tests.select("item", "text_id", "item_text")), "item-keys")
    levels = sorted(r["level"] for r in keys.select("level").distinct().collect())
    empty = docs.sparkSession.createDataFrame([], f"`{id_column}` long, `{item_column}` long, n_item_shingles long, n_shared long")
    if not levels:
        return empty
    found = stored(suspects(named, key_filter(keys, bits), levels, bits), "suspects")
    pairs = found.select("id", F.explode("keys").alias("key")).join(
        keys.select("text_id", "level", F.size("keys").alias("size"), F.explode("keys").alias("key")), "key").groupBy(
        "id", "text_id").agg(F.max("level").alias("level"), F.max("size").alias("size"), F.countDistinct("key").alias("n")).where(
        (F.col("level") > 0) | (100 * F.col("n") >= percent * F.col("size"))).select("id", "text_id")
    both = pairs.join(tests, "text_id").join(found.select("id", "text"), "id").select("id", "text", "item", "item_text")
    rows = _contained(both, percent).groupBy("id", "item").agg(
        F.max(F.struct("n_shared", "n_item_shingles")).alias("best"))
    return rows.select(F.col("id").alias(id_column), F.col("item").alias(item_column),
                       "best.n_item_shingles", "best.n_shared")


def without_leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text",
                  item_column: str = "item_id", item_text: str = "text", percent: int = PERCENT,
                  bits: int = BITS) -> DataFrame:
    """The rows that contain no item, with all their columns. Rows without an id stay as they are.

    A row is judged by its own text, whatever its id: rows go by the hash of id and text, so ids may be of any type.
    """
    require_columns(docs, id_column, text)
    key = fresh(docs, "_row")
    rows = docs.withColumn(key, F.when(field(id_column).isNotNull(), F.xxhash64(field(id_column), field(text))))
    found = leaks(rows, items, key, text, item_column, item_text, percent, bits).select(F.col(key)).distinct()
    return rows.join(found, key, "left_anti").select(*map(field, docs.columns))
