"""Byte-level BPE: texts to token ids and back, by replaying merges over the distinct words of a batch.

Method. Texts are cut before each blank that starts a piece anyway, that is, unless white space stands on both sides of it.
These parts recur, so those of a group of texts are numbered by Arrow's dictionary encoding and each different one is looked
at once: words of Latin letters, and those with a mark at the end, are told at a glance, the vocabulary's pattern cuts all
others into pieces. The different pieces that are no tokens are merged together, in one of two ways. Pieces of at most
``SHORT`` bytes stand in the columns of a matrix of pairs, and in each round every piece merges its pair of lowest rank, the
leftmost of these. For longer ones an inverted index leads from each mergeable pair to its places in all these pieces, the pair
of lowest rank is merged at every place (in a piece from the left), and only the pairs at its two neighbours are looked up
anew. Both give each piece the ids of the usual greedy encoder, lowest rank first.

Memory. The vocabulary is a file of fixed size and is sent to the tasks. Besides, a task holds a group of at most ``GROUP``
bytes of text (or one text that is longer), the number of each of its parts, and the ids of its different parts.

Edge cases. Null and empty texts have no ids. Every byte has an id, so any text can be encoded and decoding gives back
its bytes. Ids outside the vocabulary and null id lists decode to nothing. Special tokens are ordinary text. Other columns
are kept; a column with the result's name is replaced. Repeated rows and empty tables need no care.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.llm.words import U64, bytes_of, lean, slices

# Bytes of text whose words are merged together, and whose ids are put together at once.
GROUP, SLICE = 1 << 22, 1 << 19
# Bytes of a piece that is merged in rounds, so that a place in it takes ``PLACE`` bits; pieces of a matrix.
PLACE = 5
SHORT, COLUMNS = 1 << PLACE, 1 << 13
# Slots of the hash table of mergeable pairs: 2^19.
SLOTS = 19
# Stands for no pair: above every rank and place.
NO_PAIR = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read().splitlines())}


class Merges:
    """The merge table and the replay of merges over many pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise InputProblem(f"The vocabulary has no token for byte {missing[0]}.", "Use a byte-level vocabulary.")
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(rank)
        keys, merged = np.array(keys, np.int64), np.array(merged, np.int64)
        order = np.argsort(keys)
        # One key past the end keeps every search inside the table.
        self.keys, self.merged = np.append(keys[order], np.iinfo(np.int64).max), np.append(merged[order], -1)
        # A slot holds one of its pairs; those that found it taken are searched for.
        self.slot_key, self.slot_rank = np.full(1 << SLOTS, -1), np.full(1 << SLOTS, -1)
        self.shared = np.zeros(1 << SLOTS, bool)
        slot = self._slot(keys)
        self.slot_key[slot], self.slot_rank[slot] = keys, merged
        self.shared[slot[self.slot_key[slot] != keys]] = True
        self.tokens = pa.array(list(ranks), pa.binary())
        self.rank_of_token = np.array(list(ranks.values()), np.int64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        x = keys.view(U64) * U64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93) >> U64(64 - SLOTS)).view(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens, or -1."""
        key = left << 32 | right
        slot = self._slot(key)
        hit = self.slot_key[slot] == key
        out = np.where(hit, self.slot_rank[slot], -1)
        others = np.flatnonzero(~hit & self.shared[slot])
        at = np.searchsorted(self.keys, key[others])
        out[others] = np.where(self.keys[at] == key[others], self.merged[at], -1)
        return out

    def encode(self, pieces: pa.BinaryArray) -> pa.ListArray:
        """Ids of each piece."""
        rank = pc.index_in(pieces, value_set=self.tokens)
        known = rank.is_valid().to_numpy(False)
        body, offsets = bytes_of(pieces)
        sizes = np.diff(offsets)
        todo = np.flatnonzero(~known & (sizes > 0))
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        split = int(np.searchsorted(sizes[todo], SHORT, "right"))
        runs = [(np.flatnonzero(known), self.rank_of_token[rank.drop_null().to_numpy()], np.ones(int(known.sum()), np.int64))]
        for i in range(0, split, COLUMNS):
            own = todo[i:min(i + COLUMNS, split)]
            runs.append((own, *self._in_rounds(body, offsets[own], sizes[own])))
        if split < len(todo):
            own = todo[split:]
            whole = pieces.take(pa.array(own))
            runs.append((own, *self._by_rank(bytes_of(whole)[0], sizes[own])))
        # In the order of the pieces again.
        which, ids, counts = [np.concatenate(x) for x in zip(*runs)]
        place = np.zeros(len(pieces), np.int64)
        place[which] = np.arange(len(which))
        out = _lists(ids, counts)
        if len(which) < len(pieces):  # an empty piece
            place[sizes == 0], out = len(which), pa.concat_arrays([out, _lists(ids[:0], np.zeros(1, np.int64))])
        return out.take(pa.array(place))

    def _in_rounds(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (one after the other) that begin at ``starts`` and have at most ``SHORT`` bytes, and their numbers.
        Row i, column k of a matrix is byte i of piece k; a token stands at its first byte."""
        many, rows = len(sizes), int(sizes.max())
        row = np.arange(rows)[:, None]
        inside = row < sizes
        bytes_ = body[np.minimum(starts + row, len(body) - 1)]
        token = np.where(inside, self.single[bytes_], -1)
        # Row of the token after and before; ``rows`` and -1 if there is none.
        after, before = np.where(row + 1 < sizes, row + 1, rows), np.repeat(row - 1, many, 1)
        rank = np.full((rows, many), -1)
        rank[:-1] = np.where(inside[1:], self.bytes[bytes_[:-1], bytes_[1:]], -1)
        # Rank of the pair that begins at a token, and its place: the smallest is the next to be merged.
        pair = np.where(rank >= 0, rank << PLACE | row, NO_PAIR)
        token, after, before = token.ravel(), after.ravel(), before.ravel()
        columns = np.arange(many)
        while True:
            best = pair.min(axis=0)
            live = np.flatnonzero(best != NO_PAIR)
            if len(live) == 0:
                break
            if 4 * len(live) < 3 * len(best):
                pair, best, columns = pair.take(live, axis=1), best[live], columns[live]
                live = np.arange(len(live))
            column, best, width = columns[live], best[live], pair.shape[1]
            here, merged = best & (SHORT - 1), best >> PLACE
            at = here * many + column
            gone = after[at]
            far = after[gone * many + column]
            prior = before[at]
            token[at], token[gone * many + column] = merged, -1
            after[at] = far
            flat = pair.reshape(-1)
            flat[gone * width + live] = flat[here * width + live] = NO_PAIR
            right, left = np.flatnonzero(far < rows), np.flatnonzero(prior >= 0)
            far_at, prior_at = far[right] * many + column[right], prior[left] * many + column[left]
            before[far_at] = here[right]
            ranks = self.ranks_of(np.concatenate([merged[right], token[prior_at]]),
                                  np.concatenate([token[far_at], merged[left]]))
            places = np.concatenate([here[right], prior[left]])
            flat[places * width + live[np.concatenate([right, left])]] = np.where(ranks >= 0, ranks << PLACE | places, NO_PAIR)
        token = token.reshape(rows, many).T
        alive = token >= 0
        return token[alive], alive.sum(axis=1)

    def _by_rank(self, body: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (one after the other) that make up ``body``, and their numbers."""
        ends = np.cumsum(sizes)
        token = self.single[body]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        after = np.arange(1, len(token) + 1)
        after[ends - 1] = -1
        before = np.arange(-1, len(token) - 1)
        before[ends - sizes] = -1
        pair = np.full(len(token), -1)  # rank of the pair that begins at each place
        at = np.flatnonzero(after >= 0)
        pair[at] = self.bytes[body[at], body[at + 1]]

        index: dict[int, list[np.ndarray]] = {}  # the places of each mergeable pair, by its rank
        heap: list[int] = []

        def note(places: np.ndarray, ranks: np.ndarray) -> None:
            if len(places) == 0:
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, lo, hi in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
                known = index.get(rank)
                if known is None:
                    index[rank] = [places[lo:hi]]
                    heapq.heappush(heap, rank)
                else:
                    known.append(places[lo:hi])

        at = np.flatnonzero(pair >= 0)
        note(at, pair[at])
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            places = found[0] if len(found) == 1 else np.sort(np.concatenate(found))
            places = places[pair[places] == rank]
            if len(places) > 1:
                # One place in a piece at a time: a merge may bring up a pair of lower rank, which goes first.
                whose = owner[places]
                later = np.append(False, whose[1:] == whose[:-1])
                if later.any():
                    note(places[later], pair[places[later]])
                    places = places[~later]
            elif len(places) == 0:
                continue
            gone = after[places]
            far, prior = after[gone], before[places]
            token[places], token[gone] = rank, -1
            after[places] = far
            pair[places], pair[gone] = -1, -1
            has = far >= 0
            right, far = places[has], far[has]
            before[far] = right
            left = prior[prior >= 0]
            ranks = self.ranks_of(np.concatenate([token[left], token[right]]),
                                  np.concatenate([token[after[left]], token[far]]))
            both = np.concatenate([left, right])
            pair[both] = ranks
            keep = ranks >= 0
            note(both[keep], ranks[keep])
        alive = token >= 0
        return token[alive], np.diff(np.append(0, np.cumsum(alive))[np.append(0, ends)])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    places = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values.astype(np.int32)))


def _runs(body: np.ndarray, edges: np.ndarray) -> pa.BinaryArray:
    """The runs of bytes between neighbouring edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [
        None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


# ASCII white space, the separators 0x1C to 0x1F included; first two bytes of other characters that may be white.
NARROW = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
WIDE = np.isin(np.arange(1 << 16), [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380])
# Bytes of the Latin letters of one or two bytes (as \u00d7 and \u00f7 are none, they are looked for besides), and marks after them.
LATIN = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)])
MARKS = np.isin(np.arange(256), list(b".,;:!?"))


def part_edges(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where texts begin or end, and those of blanks before which the pattern never reaches across."""
    edge = np.zeros(len(body) + 1, bool)
    blank = np.flatnonzero(body == 32)
    edge[blank] = True
    # Blanks with white space on both sides, or before them and the text's end behind, may lie inside a piece. Only the few with
    # a neighbour that is white or not ASCII are looked at closely.
    padded = np.concatenate([np.zeros(3, np.uint8), body, np.zeros(2, np.uint8)])
    ends = np.zeros(len(body) + 1, bool)
    ends[offsets] = True
    odd = NARROW | (np.arange(256) >= 128)
    blank = blank[odd[padded[blank + 2]]]
    blank = blank[odd[padded[blank + 4]] | ends[blank + 1]]

    def two(at):
        return padded[at].astype(np.int64) << 8 | padded[at + 1]

    white_before = NARROW[padded[blank + 2]] | WIDE[two(blank + 1)] | WIDE[two(blank)]
    white_after = NARROW[padded[blank + 4]] | WIDE[two(blank + 4)] | ends[blank + 1]
    edge[blank[white_before & white_after]] = False
    edge[offsets] = True
    return np.flatnonzero(edge)


class Encoder:
    """Texts to ids; one object per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.pattern = regex.compile(pattern)

    def piece_edges(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Edges of the pieces of the parts between ``offsets``."""
        edge = np.zeros(len(body) + 1, bool)
        edge[offsets] = True
        other = ~LATIN[body]
        other[1:] |= (body[:-1] == 0xC3) & ((body[1:] == 0x97) | (body[1:] == 0xB7))
        starts, ends = offsets[:-1], offsets[1:]
        others = np.diff(np.append(0, np.cumsum(other))[offsets])
        word = (body[starts] == 32) & (others == 1) & (ends - starts > 1)
        marked = (body[starts] == 32) & (others == 2) & (ends - starts > 2) & MARKS[body[ends - 1]]
        edge[ends[marked] - 1] = True
        rest = np.flatnonzero(~(word | marked))
        whole, cuts = body.tobytes(), []
        for at, end in zip(starts[rest].tolist(), ends[rest].tolist()):
            text = whole[at:end].decode()
            plain = len(text) == end - at
            for piece in self.pattern.findall(text):
                at += len(piece) if plain else len(piece.encode())
                cuts.append(at)
        edge[cuts] = True
        return np.flatnonzero(edge)

    def coded(self, texts: pa.Array) -> Iterator[tuple[pa.ListArray, int, int]]:
        """(ids of each text i to j - 1, i, j) for the texts in order."""
        body, offsets = bytes_of(texts)
        for first, last in slices(offsets, GROUP):
            own, group = offsets[first:last + 1] - offsets[first], body[offsets[first]:offsets[last]]
            edges = part_edges(group, own)
            parts = _runs(group, edges).dictionary_encode()
            place = np.searchsorted(edges, own)
            part_body, part_offsets = bytes_of(parts.dictionary)
            cuts = self.piece_edges(part_body, part_offsets)
            pieces = _runs(part_body, cuts).dictionary_encode()
            ids = self.merges.encode(pieces.dictionary).take(pieces.indices)
            # Ids of each different part: those of its pieces, one after the other.
            stops = ids.offsets.to_numpy()[np.searchsorted(cuts, part_offsets)]
            ids = pa.ListArray.from_arrays(pa.array(stops), ids.values)
            for i, j in slices(own, SLICE):
                found = ids.take(parts.indices[place[i]:place[j]])
                stops = found.offsets.to_numpy()[place[i:j + 1] - place[i]]
                yield pa.ListArray.from_arrays(pa.array(stops), found.values), first + i, first + j

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        return [ids.values.to_numpy().tobytes() for found, *_ in self.coded(pa.array(texts, pa.string())) for ids in found]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``GROUP`` bytes or more, so that words of short texts are merged together too."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _others(df: DataFrame, name: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.name.lower() != name.lower()]


def _schema(df: DataFrame, others: list[str], added: str) -> str:
    parts = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others]
    return ", ".join([*parts, added])


def send_ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The rows with ``ids``, the token ids of ``text``, as an array of ints in place of ``text``."""
    require_columns(docs, text)
    others = [c for c in _others(docs, ids) if c != text]
    ranks = send_ranks(docs.sparkSession, path)

    def run(batches):
        lean()
        encoder = Encoder(ranks.value, pattern)
        for batch in _grouped(batches):
            for coded, i, j in encoder.coded(batch.column(batch.num_columns - 1)):
                yield pa.record_batch([*[c.slice(i, j - i) for c in batch.columns[:-1]], coded], names=[*others, ids])

    rows = docs.select(*[field(c) for c in others], field(text).alias("_text"))
    return rows.mapInArrow(run, _schema(docs, others, f"`{ids}` array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "token_ids", decoded: str = "bytes") -> DataFrame:
    """The rows with ``decoded``, the bytes of the tokens ``ids``, added. Valid UTF-8 wherever the ids encode a text."""
    require_columns(rows, ids)
    others = _others(rows, decoded)
    ranks = send_ranks(rows.sparkSession, path)

    def run(batches):
        lean()
        top = max(ranks.value.values(), default=-1) + 1
        tokens = [b""] * (top + 1)
        for token, rank in ranks.value.items():
            tokens[rank] = token
        for batch in batches:
            lists = batch.column(others.index(ids))
            offsets = lists.offsets.to_numpy()
            for i in range(0, len(lists), 256):  # as many rows as stay small beside the batch
                part = lists.slice(i, 256)
                flat = part.flatten()
                flat = np.where(flat.is_null().to_numpy(False), -1, flat.fill_null(0).to_numpy(False)) \
                    if flat.null_count else flat.to_numpy()
                flat = np.where((flat >= 0) & (flat < top), flat, top).tolist()
                sizes = np.where(part.is_null().to_numpy(False), 0, np.diff(offsets[i:i + len(part) + 1]))
                ends = np.cumsum(sizes)
                texts = [b"".join([tokens[k] for k in flat[b - n:b]]) for b, n in zip(ends, sizes)]
                yield pa.record_batch([*[c.slice(i, 256) for c in batch.columns], pa.array(texts, pa.binary())],
                                      names=[*others, decoded])

    return rows.select(*[field(c) for c in others]).mapInArrow(run, _schema(rows, others, f"`{decoded}` binary"))
