"""Near-duplicate documents: MinHash bands propose pairs, odd sketches weed them, full shingle sets decide.

Method. Each text becomes its set of distinct five-word shingles (A-Z lower-cased). 128 MinHash samples give 32 bands of
four and an *odd sketch*: a bitmap of 512 bits in which bit h(i, sample i) is flipped for every i. Equal samples cancel in
the XOR of two sketches, so its population count estimates the similarity, most precisely where it is high. Texts that
share a band and whose sketches do not rule out the threshold are compared by their full sets.

A pair at the threshold of 0.75 shares no band with probability 5e-6, and its sketches reject it with less than 1e-6.
A second odd sketch, of the full set and about four bits per shingle, loses nothing: two sets differ in at least as many
shingles as these bitmaps differ in bits, and at most a seventh of both sizes' sum may differ at a similarity of 0.75. It
spares most comparisons of full sets that would fail, as there are many in groups of loose copies.

Groups of copies. Documents with equal sets are one class from the start. Within a band bucket every class is first
compared with two pivots (the one with the most company in all its buckets, and the smallest id), and links are merged
into components. Only buckets that
still hold several components are searched pair by pair, in blocks of bounded size, and only pairs across components
leave the task. So a bucket of n copies costs 2n comparisons, not n^2, and no group is gathered in one task.

Edge cases. Null and blank texts have an empty set, link with nothing and are their own component. Texts of one to four
words are one shingle. Rows that share an id are one document: they are linked if any of their texts is. A row without
id is not linked: its component is null, and it is kept. Other columns of the input are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.llm.components import components
from patronage.llm.ids import fresh, require_whole_ids
from patronage.llm.membership import only
from patronage.llm.words import BASES, U64, Hasher, as_long, is_white, lean, lower_table, mixed, pieces
from patronage.scratch import stored

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
# XOR bits up to which two sketches may belong to a pair at the threshold: 57 are expected, 8 is the deviation.
MOST_FLIPS = 97
# Members of a bucket that one task compares with each other at once.
BLOCK = 1024
# Texts that are compared with one pivot in a group of rows.
SALT_ROWS = 256

SIGNATURE = "id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>, parity binary"


def shingle_sets(w, hasher: Hasher, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    hashes = hasher.of_words(w)
    grams = hasher.grams(hashes, shingle)
    counts = w.counts()
    short = hasher.sequences(hashes, w.first[:-1], w.first[1:])
    for i, n in enumerate(counts):
        if n >= shingle:
            yield np.unique(grams[w.first[i]:w.first[i + 1] - shingle + 1])
        else:
            yield short[i:i + 1] if n else short[:0]


class MinHasher:
    """MinHash samples of a set of 64-bit hashes, from its upper halves."""

    def __init__(self, samples: int):
        rng = np.random.default_rng(20240607)
        self.factor = (rng.integers(0, 1 << 31, samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.shift = rng.integers(0, 1 << 32, samples, dtype=np.uint32)[:, None]

    def samples(self, members: np.ndarray) -> np.ndarray:
        x = (members >> U64(32)).astype(np.uint32)
        parts = [(x[i:i + 1024] * self.factor + self.shift).min(axis=1) for i in range(0, len(x), 1024)]
        return parts[0] if len(parts) == 1 else np.minimum.reduce(parts)


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, samples) to (texts, bands): one 64-bit key per band."""
    grouped = samples.reshape(len(samples), bands, rows).astype(U64)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=U64)), grouped.shape[:2])
    for r in range(rows):
        key = mixed(key * U64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """(texts, samples) to (texts, bits / 64) words of the parity bitmap."""
    n, k = samples.shape
    place = mixed(samples.astype(U64) + (np.arange(1, k + 1, dtype=U64) << U64(32))) & U64(bits - 1)
    cell = (np.arange(n, dtype=np.int64)[:, None] * bits + place.astype(np.int64)).ravel()
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view(U64)


def parity(members: np.ndarray) -> bytes:
    """Odd sketch of a full set: 512 bits or the power of two from four bits a member on."""
    bits = max(512, 1 << int(4 * len(members) - 1).bit_length())
    odd = np.bincount((members & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Rows of parity words brought to ``size`` words; the upper half falls on the lower one."""
    while words.shape[1] > size:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def signatures(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, 128-bit fingerprint of the set (f1, f2), band keys and odd sketch of every row."""
    require_whole_ids(docs, id_column)
    require_columns(docs, text)

    def run(batches):
        lean()
        white, fold, hasher, minhash = is_white(), lower_table(), Hasher(BASES[0]), MinHasher(BANDS * ROWS)
        for batch in batches:
            for i, j, w in pieces(batch.column(1), white, fold):
                n = np.zeros(j - i, np.int64)
                prints = np.zeros((2, j - i), U64)
                samples = np.zeros((j - i, BANDS * ROWS), np.uint32)
                full = []
                for t, members in enumerate(shingle_sets(w, hasher, SHINGLE)):
                    n[t] = len(members)
                    full.append(parity(members) if len(members) else b"")
                    if len(members):
                        prints[0, t] = mixed(members).sum(dtype=U64)
                        prints[1, t] = mixed(members ^ U64(BASES[1])).sum(dtype=U64)
                        samples[t] = minhash.samples(members)
                width = np.where(n > 0, BANDS, 0)
                bands = band_keys(samples, BANDS, ROWS)[n > 0].ravel()
                sketch = odd_sketches(samples, SKETCH_BITS)
                yield pa.record_batch([
                    batch.column(0).slice(i, j - i), pa.array(n), as_long(prints[0]), as_long(prints[1]),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)), pa.int32()), as_long(bands)),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(j - i + 1) * sketch.shape[1], pa.int32()), as_long(sketch.ravel())),
                    pa.array(full, pa.binary())],
                    names=["id", "n_shingles", "f1", "f2", "bands", "sketch", "parity"])

    return docs.select(field(id_column).cast("long").alias("id"), field(text).alias("text")).mapInArrow(run, SIGNATURE)


def flips(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ."""
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def near(n_a: Column, n_b: Column, percent: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. ``docs``: id, text.

    Texts travel to their partner in ``a``; a partner with many pairs is given out several times, so that no group of
    rows exceeds ``SALT_ROWS`` pairs by much, and a task holds one set at a time.
    """
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    mine = load.join(docs, F.col("a") == F.col("id")).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    theirs = pairs.join(load, "a").join(docs, F.col("b") == F.col("id")).select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "text")
    rows = mine.union(theirs).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        lean()
        white, fold, hasher = is_white(), lower_table(), Hasher(BASES[0])
        key, own = None, []
        for batch in batches:
            a, part, b = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, _, w in pieces(batch.column(3), white, fold):
                for t, members in enumerate(shingle_sets(w, hasher, SHINGLE), i):
                    if b[t] is None:
                        own = own if key == (a[t], part[t]) else []
                        key = (a[t], part[t])
                        own.append(members)
                        continue
                    for mine in own:
                        place = np.minimum(np.searchsorted(mine, members), len(mine) - 1)
                        both = int((mine[place] == members).sum())
                        if 100 * both >= percent * (len(mine) + len(members) - both):
                            found.append((a[t], b[t]))
                            break
            yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def possible(full: list[np.ndarray], width: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray,
             percent: int) -> np.ndarray:
    """Which pairs (x, y) of sets may reach the threshold, by their parity bitmaps; never says no to one that does."""
    out = np.zeros(len(x), bool)
    small = np.minimum(width[x], width[y])
    for size in np.unique(small):
        rows = {}
        for wide in np.unique(width[width >= size]):
            own = np.flatnonzero(width == wide)
            rows.update(zip(own.tolist(), folded(np.stack([full[k] for k in own]), size)))
        at = np.flatnonzero(small == size)
        for i in range(0, len(at), 4096):
            part = at[i:i + 4096]
            a, b = np.stack([rows[k] for k in x[part].tolist()]), np.stack([rows[k] for k in y[part].tolist()])
            differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            out[part] = differ * (100 + percent) <= (100 - percent) * (n[x[part]] + n[y[part]])
    return out


def across(groups: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components within each (bucket, i, j) block that sketches do not rule out.

    ``groups``: bucket, i, j, block, id, label, n_shingles, sketch, parity, p1, p2. Pairs with a pivot have been compared
    before.
    """
    names = ["bucket", "i", "j", "block", "id", "label", "n_shingles", "p1", "p2", "sketch", "parity"]
    rows = groups.select(*names).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def pairs(table: pa.Table):
        col = {c: table[c].to_numpy() for c in names[1:9]}
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(U64).reshape(len(table), -1)
        full = [np.frombuffer(x, U64) for x in table["parity"].to_pylist()]
        width = np.array([len(x) for x in full])
        diagonal = col["i"][0] == col["j"][0]
        other = np.arange(len(table)) if diagonal else np.flatnonzero(col["block"] == col["j"][0])
        first = other if diagonal else np.flatnonzero(col["block"] == col["i"][0])
        pivot = (col["id"] == col["p1"]) | (col["id"] == col["p2"])
        other, first = other[~pivot[other]], first[~pivot[first]]
        for s in range(0, len(first), 128):
            mine = first[s:s + 128]
            far = np.zeros((len(mine), len(other)), np.uint16)
            for word in range(sketch.shape[1]):
                far += np.bitwise_count(sketch[mine, word][:, None] ^ sketch[other, word][None, :])
            n, m = col["n_shingles"][mine][:, None], col["n_shingles"][other][None, :]
            ok = (far <= MOST_FLIPS) & (col["label"][mine][:, None] != col["label"][other][None, :]) \
                & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            if diagonal:
                ok &= col["id"][mine][:, None] < col["id"][other][None, :]
            x, y = np.nonzero(ok)
            x, y = mine[x], other[y]
            keep = possible(full, width, col["n_shingles"], x, y, percent)
            x, y = x[keep], y[keep]
            if len(x):
                a, b = col["id"][x], col["id"][y]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        lean()
        kept, key = [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(keys))):
                if kept and tuple(keys[lo]) != key:
                    yield from pairs(pa.Table.from_batches(kept))
                    kept = []
                key = tuple(keys[lo])
                kept.append(batch.slice(lo, hi - lo))
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """One row per input row: id column, n_shingles, component_id, kept. See the module for method and edge cases."""
    signed = stored(signatures(docs, id_column, text), "signatures")
    print_columns = ["n_shingles", "f1", "f2"]
    usable = signed.where("n_shingles > 0 and id is not null")
    classes = usable.groupBy(*print_columns).agg(F.min("id").alias("rep"))
    chosen = usable.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    members = chosen.select("id", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    crowded = stored(members.join(sizes, "bucket"), "buckets")
    # The text others are copied from shares more and larger buckets than its copies: a pivot that links most of them.
    central = crowded.groupBy("id").agg(F.sum("size").alias("central"))
    rank = F.col("central") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    busy = crowded.join(central, "id").groupBy("bucket").agg(
        F.max_by("id", rank).alias("p1"), F.min("id").alias("p2"))
    shared = stored(crowded.join(busy, "bucket"), "buckets")
    sketches = chosen.select("id", "n_shingles", "sketch", "parity")

    pivots = shared.select(F.explode(F.array("p1", "p2")).alias("a"), F.col("id").alias("b")).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = sketches.alias("x"), sketches.alias("y")
    likely = pivots.join(left, F.col("a") == F.col("x.id")).join(right, F.col("b") == F.col("y.id")).where(
        near(F.col("x.n_shingles"), F.col("y.n_shingles"), percent)
        & (flips(F.col("x.sketch"), F.col("y.sketch")) <= MOST_FLIPS)).select("a", "b").distinct()
    named = docs.select(field(id_column).cast("long").alias("id"), field(text).alias("text"))
    texts = only(named, shared)
    links = stored(verified(stored(likely, "pairs"), texts, percent), "links")

    found = components(links)
    labelled = shared.join(found.select("id", F.col("root").alias("label")), "id", "left").withColumn(
        "label", F.coalesce("label", "id"))
    open_buckets = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(
        "low <> high").select("bucket")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    blocks = labelled.where("size > 2").join(open_buckets, "bucket").withColumn("parts", parts).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
        {"i": F.least("block", "k"), "j": F.greatest("block", "k")}).drop("size", "parts", "k")
    more = stored(across(blocks.join(sketches, "id"), percent), "pairs")
    if not more.isEmpty():
        found = components(links.union(verified(more, texts, percent)))

    # Written, so that the last join has a shuffle of its own on both sides, and a class of very many copies is split.
    root = stored(classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        *print_columns, F.coalesce("root", "rep").alias("component")), "classes")
    out = signed.select("id", *print_columns).join(root, print_columns, "left").withColumn(
        "component_id", F.when(F.col("id").isNull(), None).when(F.col("n_shingles") > 0, F.col("component"))
        .otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                            percent: int = PERCENT) -> DataFrame:
    """The rows of one document per component, with all their columns: the smallest id's.

    Here a row is a document, so unlike texts under one id both stay, and ids may be of any type that can be ordered. Of
    copies under one id the smallest text hash stays; of blank texts under one id, one. Rows without an id stay as they are.
    """
    require_columns(docs, id_column, text)
    key = fresh(docs, "_row")
    # Written, so that a row has the same number whenever it is read.
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    own = rows.select(F.col(key).alias("row"), field(id_column).alias("id"), field(text).alias("text")).where("id is not null")
    judged = near_duplicates(own, "row", "text", percent)
    places = own.select("row", "id", F.xxhash64("text").alias("print"))
    blank = F.col("n_shingles") == 0
    # Partial minima: a component of very many rows is one row per task.
    kept = judged.select("row", "n_shingles", "component_id").join(places, "row").groupBy(
        F.when(~blank, F.col("component_id")).alias("component"), F.when(blank, F.col("id")).alias("blank")).agg(
        F.min(F.struct("id", "print", "row"))["row"].alias("_kept"))
    one = rows.join(kept.select(F.col("_kept").alias(key)), key, "left_semi")
    return one.unionByName(rows.where(field(id_column).isNull())).select(*map(field, docs.columns))
