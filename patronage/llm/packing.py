"""Token ids packed into rows of one length: best-fit-decreasing, with a segment tree over free capacities.

Method. Documents longer than a row are split without loss into parts of full rows and a rest. Parts are packed in the order
of falling length: each goes to the open row with the least free room that still holds it. Rows are grouped by free room,
and a segment tree over the amounts of room finds the smallest sufficient one in log2(row length) steps. Each packed row
carries its ids (padded), the cumulative lengths of its segments, and position numbers that restart with every segment, as
attention kernels for packed sequences want them.

Packing needs to see a pool of parts, not the corpus: every task packs what it reads in pools of ``POOL`` tokens, so nothing
is shuffled and memory is bounded. Rows that a pool leaves partly empty are at most as many as best-fit-decreasing leaves on
that pool; with thousands of rows a pool the fill is that of a corpus-wide run to within a fraction of a row each. Parts are
ordered by (length, place in the pool), so a task that is run again gives the same rows.

Edge cases. Null and empty id lists take no room and appear in no row. A document whose length is a multiple of the row
length has no rest. Repeated rows are packed as often as they occur. Extra columns are dropped, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.llm.ids import require_whole_ids

ROW = 2048
POOL = 1 << 22

SCHEMA = ("ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<long>, parts array<int>, "
          "n_tokens int")


class Rooms:
    """Amounts of free room 0 to ``row`` with a count of open rows each; finds the smallest sufficient amount."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += change
            node >>= 1

    def at_least(self, need: int) -> int:
        """Smallest amount >= need with an open row, or -1."""
        node = need + self.size
        if self.tree[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Indices of the parts of each packed row; ``lengths`` lie between 1 and ``row``."""
    rooms, open_rows, out = Rooms(row), {}, []
    for part in np.lexsort((np.arange(len(lengths)), -lengths)).tolist():
        need = int(lengths[part])
        room = rooms.at_least(need) if need < row else -1
        if room < 0:
            place, room = len(out), row
            out.append([])
        else:
            place = open_rows[room].pop()
            rooms.add(room, -1)
        out[place].append(part)
        if room > need:
            open_rows.setdefault(room - need, []).append(place)
            rooms.add(room - need, 1)
    return out


def _packed(pool: list[tuple[int | None, int, np.ndarray]], row: int, pad: int) -> pa.RecordBatch:
    lengths = np.array([len(ids) for *_, ids in pool])
    rows = best_fit_decreasing(lengths, row)
    ids = np.full((len(rows), row), pad, np.int32)
    position = np.zeros((len(rows), row), np.int32)
    order = [p for parts in rows for p in parts]
    sizes = lengths[order]
    per_row = np.array([len(parts) for parts in rows])
    ends = np.cumsum(sizes)
    first = np.append(0, np.cumsum(per_row))
    filled = np.diff(np.append(0, ends)[first])
    flat = np.concatenate([pool[p][2] for p in order])
    inside = np.arange(row)[None, :] < filled[:, None]
    ids[inside] = flat
    position[inside] = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    # Cumulative lengths per row, from 0 on.
    base = np.append(0, ends)[first[:-1]]
    cumulative = np.insert(ends - np.repeat(base, per_row), first[:-1], 0).astype(np.int32)

    def lists(values, offsets):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

    whole = np.arange(len(rows) + 1) * row
    return pa.record_batch([
        lists(ids.ravel(), whole), lists(cumulative, first + np.arange(len(first))), lists(position.ravel(), whole),
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array([pool[p][0] for p in order], pa.int64())),
        lists(np.array([pool[p][1] for p in order], np.int32), first), pa.array(filled.astype(np.int32))],
        names=[c.split()[0] for c in SCHEMA.split(", ")])


def packed(rows: DataFrame, id_column: str = "doc_id", ids: str = "token_ids", row: int = ROW, pad: int = 0,
           pool: int = POOL) -> DataFrame:
    """Packed rows: ids (``row`` of them), cu_seqlens (0 first), position_ids, doc_ids and parts (one per segment, the part's
    number in its document), n_tokens (ids before the padding)."""
    require_whole_ids(rows, id_column)
    require_columns(rows, ids)
    if row < 1:
        raise InputProblem("A row holds at least one token.")

    def run(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            for t, name in enumerate(batch.column(0).to_pylist()):
                tokens = lists[t].values
                if tokens is None or not len(tokens):
                    continue
                tokens = tokens.to_numpy(zero_copy_only=False)
                for part, i in enumerate(range(0, len(tokens), row)):
                    held.append((name, part, tokens[i:i + row].copy()))
                size += len(tokens)
                if size >= pool:
                    yield _packed(held, row, pad)
                    held, size = [], 0
        if held:
            yield _packed(held, row, pad)

    named = rows.select(field(id_column).cast("long").alias("id"), field(ids).alias("ids"))
    return named.mapInArrow(run, SCHEMA)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Packed rows as binary columns of little-endian 32-bit numbers, one Parquet row per packed row."""
    def run(batches):
        for batch in batches:
            columns = []
            for name in ("ids", "position_ids", "cu_seqlens"):
                lists = batch.column(batch.schema.names.index(name))
                columns.append(pa.array([x.values.to_numpy().astype("<i4").tobytes() for x in lists], pa.binary()))
            yield pa.record_batch(columns, names=["ids", "position_ids", "cu_seqlens"])

    rows.select("ids", "position_ids", "cu_seqlens").mapInArrow(
        run, "ids binary, position_ids binary, cu_seqlens binary").write.mode("errorifexists").parquet(path)


def digest(rows: DataFrame) -> DataFrame:
    """One line per packed row for checks: doc_ids, parts, cu_seqlens, n_tokens and hashes of the two wide columns."""
    return rows.select("doc_ids", "parts", "cu_seqlens", "n_tokens", F.xxhash64("ids").alias("ids_hash"),
                       F.xxhash64("position_ids").alias("positions_hash"))
