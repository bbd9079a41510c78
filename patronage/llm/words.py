"""Words of a batch of texts as NumPy arrays, and hashes of words and word sequences.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text. Hashes are polynomials modulo
2^64 with odd bases: prefix sums give the hash of any run of bytes or words without a loop over them. Two hashes
with different bases together make 128 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

# The white space that separates words.
WHITE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
# Bytes of text that are hashed together; keeps the temporary arrays of a task at some tens of MB.
CHUNK = 1 << 20
# Two odd multipliers; any odd 64-bit numbers without structure do.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


# Fixed values of the C library's mallopt: least size that is mapped by itself, free memory at the end that is given back.
MAPPED, TRIMMED = -3, -1
# Arrays of this size on are mapped by themselves.
LARGE = 1 << 19


def lean() -> None:
    """Called first in a task: what Arrow and NumPy free goes back to the system, and what earlier tasks have left, so that
    a worker that waits for its next task is small. By default the C library keeps arrays of up to 32 MB."""
    pa.set_memory_pool(pa.system_memory_pool())
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):  # the C library of Linux
        library.mallopt(MAPPED, LARGE)
        library.mallopt(TRIMMED, LARGE)
        library.malloc_trim(0)


def is_white() -> np.ndarray:
    table = np.zeros(256, bool)
    table[WHITE] = True
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """base^i and base^-i modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Sums of values[i] * base^i over the first 0, 1, 2, ... values."""
        self.need(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.up[:len(values)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever the run stands."""
        return (prefix[ends] - prefix[starts]) * self.down[starts]


class Hasher:
    """Hashes of one base; one object per task keeps the power tables."""

    def __init__(self, base: int):
        self.bytes, self.words = Powers(base), Powers(base ^ 0x5851F42D4C957F2C)

    def of_words(self, w: Words) -> np.ndarray:
        prefix = self.bytes.prefix(w.data.astype(U64) + U64(1))
        return mixed(self.bytes.runs(prefix, w.starts, w.ends))

    def grams(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of the k words from each word on; past the end of the batch words count as nothing."""
        self.words.need(k + 1)
        out = hashes * self.words.up[0]
        for j in range(1, k):
            out[:-j or None] += hashes[j:] * self.words.up[j]
        return mixed(out)

    def sequences(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from start to end, and of their number."""
        prefix = self.words.prefix(hashes)
        return mixed(self.words.runs(prefix, starts, ends) + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


class Words:
    """Word positions of several texts: ``starts`` and ``ends`` are byte places in ``data``; the words of text i are
    ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, white: np.ndarray):
        n = len(data)
        inside = ~white[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        stops[:-1] &= ~inside[1:] | cut[1:n]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def words_left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, body = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    if body is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that is longer."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), rows)
        yield i, j
        i = j


def pieces(texts: pa.Array, white: np.ndarray, fold: np.ndarray | None = None,
           limit: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) for slices of a batch; ``fold`` maps bytes first, e.g. to lower case."""
    data, offsets = bytes_of(texts)
    for i, j in slices(offsets, limit):
        part = data[offsets[i]:offsets[j]]
        yield i, j, Words(part if fold is None else fold[part], offsets[i:j + 1] - offsets[i], white)


def as_long(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
