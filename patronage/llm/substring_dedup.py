"""Repeated passages: seed on winnowed anchors, extend both ways, keep what repeats over the length threshold.

A window is ``length`` consecutive words of one document (words: runs without 0x20 and 0x09-0x0D, unchanged). A word is
covered when one of its windows has the words of a window that starts earlier: in a document with a smaller id, or
further up in the same one. Windows are judged on the input, and the union of the covered ones is every maximal repeat
of at least ``length`` words.

Method. Every window is represented by its *anchor*, the five-word sequence in it whose hash is smallest (the first of
equal ones). Equal windows have equal anchors at equal places, so repeats are sought among occurrences of one anchor
only, about one per nine words. All windows that share an anchor occurrence form a *unit*: the anchor with as much text
on both sides as it can carry.

1. Seeds: units travel by anchor. An occurrence of a unit that is not the first is covered whole. Units with the same
   anchor but other surroundings may still share some windows.
2. Extension: the first occurrence of each such unit is looked at window by window, by 128-bit hashes of all words.
3. Covered windows of a document are put together and its words cut.

A unit or window that occurs again within a batch of documents is settled there, and only its first occurrence in the
batch is shuffled. So a passage that a third of all documents hold is one row per batch, and no group is gathered: rows
are sorted by Spark and read one after another.

The documents are shuffled once: looking at windows and cutting words use the same exchange.

Edge cases. A null text has no words. Rows without an id are left as they are: nothing is removed from them and they
cover nothing (the smallest long is their mark, and no id). Rows that share an id are told apart by their text's hash,
in its order; equal rows are alike, so each keeps what the first keeps. Texts with fewer words than a window keep them all. Extra columns are passed on by
``without_repeats``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.llm.ids import require_whole_ids
from patronage.llm.words import BASES, U64, Hasher, as_long, is_white, lean, pieces

LENGTH = 20
ANCHOR = 5
# Units after which a task settles what repeats among them, in rows of about 50 bytes.
FLUSH = 1 << 19

PLACE = "id long, version int, start int, windows int"
NO_ID = -(1 << 63)
UNIT = f"key long, print long, {PLACE}"
# What is known of a run of windows: covered for certain, or to be looked at window by window.
COVERED, OPEN = 1, 2
FOUND = f"{PLACE}, state int"


def _rows_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """The columns as c0, c1, ..., then id, version (the text's hash, which tells rows with the same id apart) and text.

    No two names can clash, and as neither key is null the same rows serve inner and outer joins.
    """
    require_whole_ids(docs, id_column)
    require_columns(docs, text)
    columns = [field(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c != text]
    return docs.select(*columns, F.coalesce(field(id_column).cast("long"), F.lit(NO_ID)).alias("id"),
                       F.hash(F.coalesce(field(text), F.lit(""))).alias("version"), field(text).alias("text"))


def _anchored(grams: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: their first and last window, and the anchor's place."""
    span = length - ANCHOR + 1
    least = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    width = 1
    while width < span:
        step = min(width, span - width)
        least[:len(least) - step] = np.minimum(least[:len(least) - step], least[step:])
        width += step
    anchor = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last], anchor[first]


def _settled(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, print, id, version, start, windows): the first occurrences, and the others put together to runs."""
    table = np.concatenate(rows, axis=1)
    table = table[:, np.lexsort(table[4::-1])]
    alike = table[:, 1:] == table[:, :-1]
    table = table[:, np.append(True, ~alike[:5].all(axis=0))]  # a row of the input may be repeated
    again = np.append(False, (table[:2, 1:] == table[:2, :-1]).all(axis=0))
    first, runs = table[:, ~again], table[:, again]
    runs = runs[:, np.lexsort(runs[4:1:-1])]
    if runs.shape[1]:
        joined = (runs[2:4, 1:] == runs[2:4, :-1]).all(axis=0) & (runs[4, 1:] <= runs[4, :-1] + runs[5, :-1])
        heads = np.flatnonzero(np.append(True, ~joined))
        stop = np.maximum.reduceat(runs[4] + runs[5], heads)
        runs = runs[:, heads]
        runs[5] = stop - runs[4]
    return first, runs


def _rows(table: np.ndarray, state: int | None) -> pa.RecordBatch:
    """Unit rows as Arrow; settled ones lose their key, which spreads them over tasks by document."""
    n = table.shape[1]
    state = pa.array(np.full(n, state or 0, np.int32))
    return pa.record_batch([*map(pa.array, table[:3]), *[pa.array(c.astype(np.int32)) for c in table[3:]], state],
                           names=["key", "print", "id", "version", "start", "windows", "state"])


def _flushed(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if rows:
        first, again = _settled(rows)
        yield _rows(first, None)
        again[0], again[1] = again[3] ^ again[4], again[2]
        yield _rows(again, COVERED)


def units(rows_of: DataFrame, length: int) -> DataFrame:
    """Units of every text; ``state`` is COVERED for those that this task has seen earlier, else 0."""
    def run(batches):
        lean()
        white, hasher, second = is_white(), Hasher(BASES[0]), Hasher(BASES[1])
        rows, held = [], 0
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, w in pieces(batch.column(2), white):
                starts = np.flatnonzero(w.words_left() >= length)
                if not len(starts):
                    continue
                grams = hasher.grams(hasher.of_words(w), ANCHOR)
                low, high, anchor = _anchored(grams, starts, length)
                # The place of the anchor in its unit is part of the unit's identity.
                inner = second.sequences(second.of_words(w), low, high + length) ^ (anchor - low).astype(U64)
                text = np.searchsorted(w.first, low, "right") - 1
                rows.append(np.stack([grams[anchor].view(np.int64), inner.view(np.int64), ids[i:j][text],
                                      versions[i:j][text], low - w.first[text], high - low + 1]))
                held += len(low)
                if held >= FLUSH:
                    yield from _flushed(rows)
                    rows, held = [], 0
        yield from _flushed(rows)

    return rows_of.where(F.col("id") != NO_ID).select("id", "version", "text").mapInArrow(run, f"{UNIT}, state int")


def judged(rows: DataFrame, by_window: bool) -> DataFrame:
    """Which units are covered: those with an earlier equal one. The first one of its kind is OPEN if its anchor also
    stands in other surroundings; with ``by_window`` there are none."""
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "print", "id", "version", "start")
    names = ["id", "version", "start", "windows"]

    def run(batches):
        lean()
        last_key = last_print = last = None
        lone: pa.RecordBatch | None = None  # the first unit of the anchor at hand, while it is the only one
        for batch in batches:
            if not batch.num_rows:
                continue
            key, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = batch.column(6).to_numpy() == COVERED
            # Settled rows are passed on; they stand aside in the comparison of neighbours.
            yield _found(batch, np.flatnonzero(done), COVERED, names)
            at = np.flatnonzero(~done)
            if not len(at):
                continue
            place = np.stack([batch.column(c).to_numpy()[at].astype(np.int64) for c in (2, 3, 4)])
            new = np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0) | (key[at][1:] != key[at][:-1])
                            | (prints[at][1:] != prints[at][:-1]))
            new[0] = (key[at[0]], prints[at[0]], *place[:, 0]) != last  # a row of the input may be repeated
            at, place = at[new], place[:, new]
            if not len(at):
                continue
            last = (key[at[-1]], prints[at[-1]], *place[:, -1])
            key, prints = key[at], prints[at]
            same_key, same = np.zeros(len(at), bool), np.zeros(len(at), bool)
            same_key[1:] = key[1:] == key[:-1]
            same[1:] = same_key[1:] & (prints[1:] == prints[:-1])
            same_key[0] = last_key is not None and key[0] == last_key
            same[0] = same_key[0] and prints[0] == last_print
            yield _found(batch, at[same], COVERED, names)
            if not by_window:
                heads = np.flatnonzero(~same)  # first occurrences
                follows = same_key[heads]      # of an anchor that has had another unit
                if lone is not None and len(heads) and follows[0]:
                    yield lone
                if len(heads):
                    lone = None
                followed = np.append(follows[1:], False)
                yield _found(batch, at[heads[follows | followed]], OPEN, names)
                if len(heads) and not follows[-1]:
                    lone = _found(batch, at[heads[-1:]], OPEN, names)
            last_key, last_print = key[-1], prints[-1]

    return sorted_rows.mapInArrow(run, FOUND)


def _found(batch: pa.RecordBatch, rows: np.ndarray, state: int, names: list[str]) -> pa.RecordBatch:
    part = batch.take(pa.array(rows))
    return pa.record_batch([part.column(c) for c in names] + [pa.array(np.full(len(rows), state, np.int32))],
                           names=[*names, "state"])


def windows(rows_of: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """One row (key and print: 128 bits of its words) for each window of the OPEN units."""
    open_units = found.where(F.col("state") == OPEN).groupBy("id", "version").agg(
        F.collect_list(F.struct("start", "windows")).alias("runs"))
    # All columns pass through, also those not needed here: only then is the exchange the one of ``without_repeats``.
    texts = rows_of.join(open_units, ["id", "version"])
    at_id, at_version, at_text, at_runs = (texts.columns.index(c) for c in ("id", "version", "text", "runs"))

    def run(batches):
        lean()
        white, hasher, second = is_white(), Hasher(BASES[0]), Hasher(BASES[1])
        rows, held = [], 0
        for batch in batches:
            ids, versions = batch.column(at_id).to_numpy(), batch.column(at_version).to_numpy()
            runs = batch.column(at_runs)
            offsets = runs.offsets.to_numpy()
            inner = runs.flatten()
            begin, count = inner.field(0).to_numpy(), inner.field(1).to_numpy()
            offsets = offsets - offsets[0]
            for i, j, w in pieces(batch.column(at_text), white):
                lo, hi = offsets[i], offsets[j]
                owner = np.repeat(np.arange(j - i), np.diff(offsets[i:j + 1]))
                n = count[lo:hi].astype(np.int64)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                text = np.repeat(owner, n)
                start = np.repeat(begin[lo:hi].astype(np.int64), n) + step
                at = start + w.first[text]
                a = hasher.sequences(hasher.of_words(w), at, at + length)
                b = second.sequences(second.of_words(w), at, at + length)
                rows.append(np.stack([a.view(np.int64), b.view(np.int64), ids[i:j][text], versions[i:j][text], start,
                                      np.ones(len(at), np.int64)]))
                held += len(at)
                if held >= FLUSH:
                    yield from _flushed(rows)
                    rows, held = [], 0
        yield from _flushed(rows)

    return texts.mapInArrow(run, f"{UNIT}, state int")


def _spans(rows_of: DataFrame, length: int) -> DataFrame:
    seeds = judged(units(rows_of, length), by_window=False)
    single = judged(windows(rows_of, seeds, length), by_window=True)
    covered = seeds.where(F.col("state") == COVERED).union(single)
    return covered.groupBy("id", "version").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))


def repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document with repeats: id, version (hash of its text), spans (runs of covered windows: first start, number)."""
    return _spans(_rows_of(docs, id_column, text), length)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    length: int = LENGTH, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows with repeated words cut from ``text``; what is left of a cut text is joined by single blanks, a text
    without repeats stays as it is. ``counts`` names two more columns: words before, and words cut."""
    rows_of = _rows_of(docs, id_column, text)
    rows = rows_of.join(_spans(rows_of, length), ["id", "version"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    others = [c for c in rows.columns if c not in ("id", "version", "text", "spans")]
    places = [rows.columns.index(c) for c in others]
    at_text, at_spans = rows.columns.index("text"), rows.columns.index("spans")

    def run(batches):
        lean()
        white = is_white()
        for batch in batches:
            spans = batch.column(at_spans)
            totals, gone, texts = [], [], []
            for i, j, w in pieces(batch.column(at_text), white):
                own, data = batch.column(at_text).slice(i, j - i).to_pylist(), w.data.tobytes()
                sizes = w.counts()
                for t in range(j - i):
                    n, runs = int(sizes[t]), spans[i + t]
                    totals.append(n)
                    if not runs.is_valid:
                        gone.append(0)
                        texts.append(own[t])
                        continue
                    edge = np.zeros(n + 1, np.int64)
                    begin, count = runs.values.field(0).to_numpy(), runs.values.field(1).to_numpy()
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + count + length - 1, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + w.first[t]
                    gone.append(n - len(left))
                    texts.append(b" ".join([data[a:b] for a, b in zip(w.starts[left], w.ends[left])]).decode())
            yield pa.record_batch([*[batch.column(k) for k in places], pa.array(texts, pa.string()),
                                   pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                                  names=[*others, "text", "n_words", "n_cut"])

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in others], "text string, n_words long, n_cut long"])
    out = rows.mapInArrow(run, schema)
    named = [F.col("text" if c == text else f"c{k}").alias(c) for k, c in enumerate(docs.columns)]
    if counts:
        named += [F.col("n_words").alias(counts[0]), F.col("n_cut").alias(counts[1])]
    return out.select(*named)
