"""A set of 64-bit keys as a bitmap of fixed size, small enough to send to every task.

The bitmap answers "perhaps" or "certainly not": it saves shuffling rows that cannot match and never loses one. Its
size is a parameter, not a function of the data; with too many keys it merely lets more rows through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.words import U64, lean, mixed

BITS = 24  # 2^24 bits: 2 MB


def bitmap(df: DataFrame, key: Column, bits: int = BITS) -> np.ndarray:
    """Bitmap with two bits for each non-null value of ``key``, a long. At most 2^(bits-6) rows reach the driver."""
    hashed = [F.xxhash64(key, F.lit(seed)).bitwiseAND((1 << bits) - 1) for seed in (1, 2)]
    places = df.where(key.isNotNull()).select(F.explode(F.array(*hashed)).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("mask"))
    out = np.zeros(1 << (bits - 6), np.int64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(U64)


def perhaps(filled: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (filled[(places >> U64(6)).astype(np.int64)] >> (places & U64(63))) & U64(1) == U64(1)


def key_bitmap(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The same for keys that tasks look up themselves; merge those of several tasks with ``|``."""
    out = np.zeros(1 << (bits - 6), U64)
    for places in _places(keys, bits):
        np.bitwise_or.at(out, (places >> U64(6)).astype(np.int64), U64(1) << (places & U64(63)))
    return out


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    k = mixed(keys.astype(U64, copy=False))
    return [k >> U64(64 - bits), (k & U64(0xFFFFFFFF)) >> U64(32 - bits)]


def maybe_in(filled: np.ndarray, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Indices of the keys that may be in the set of ``key_bitmap``."""
    k = mixed(keys)
    first = np.flatnonzero(perhaps(filled, k >> U64(64 - bits)))
    second = (k[first] & U64(0xFFFFFFFF)) >> U64(32 - bits)
    return first[perhaps(filled, second)]


def only(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (id, text) whose id may be among the ids of ``wanted``: most others are dropped before any shuffle."""
    bits = bitmap(wanted, F.col("id"))
    sent = named.sparkSession.sparkContext.broadcast(bits)
    mask = len(bits) * 64 - 1

    def run(batches):
        lean()
        filled = sent.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in (2, 3):
                place = batch.column(c).to_numpy().view(U64) & U64(mask)
                keep &= (filled[(place >> U64(6)).astype(np.int64)] >> (place & U64(63))) & U64(1) == U64(1)
            yield pa.record_batch([x.filter(pa.array(keep)) for x in batch.columns[:2]], names=["id", "text"])

    hashed = named.where(F.col("id").isNotNull()).select(
        "id", "text", F.xxhash64("id", F.lit(1)).alias("h1"), F.xxhash64("id", F.lit(2)).alias("h2"))
    return hashed.mapInArrow(run, "id long, text string")
