"""Text as numbered words for language models, and lookups in sorted hash tables."""

from __future__ import annotations

import numpy as np

from patronage.llm.words import U64


def separators() -> np.ndarray:
    """Every ASCII byte that is neither letter nor digit parts words."""
    table = np.zeros(256, bool)
    table[:128] = True
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        table[lo:hi] = False
    return table


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """The value before each one in its text; ``start`` for the first of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[first[:-1][np.diff(first) > 0]] = start
    return out


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash for two, order included."""
    x = left * U64(0x9E3779B97F4A7C15) + right
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(29))
