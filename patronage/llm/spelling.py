"""Words that differ in one letter, found over numbered trie nodes, and the spelling each of them stands for.

*Method.* All words stand in a trie and, reversed, in a second one. Each node has a whole number, so a prefix or a suffix of a
word, however long, is one number. A word without its i-th letter is the pair (node of what is before, node of what is
after); two words that agree in such a pair differ by a replaced letter at i. A whole word, parted at i, is a pair too; where it
equals the pair of a longer word without its i-th letter, that letter was inserted. Pairs are joined by grouping; a
group has at most one word per letter of the alphabet and the one without the letter, so it is bounded by the alphabet, not by
the data. A letter within a run of equal ones may be deleted anywhere in the run with the same result; only the last place
counts, so a pair of words meets once.

*Numbering.* The first five letters of a word name its subtrie, which one task numbers in sorted order, one word at a time: a
word keeps the nodes it shares with the word before and gets new ones for the rest. A node is (five letters, number within the
subtrie) in 64 bits, an upper node is its letters. Numbers of whole words follow the order of the words.

*Words.* Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text, A-Z lower-cased. With h the unsigned CRC-32 of
``<id>:<run>``: if 31 divides h, the run loses the code point at h % length. Words are the results with ``shortest`` code points
or more that occur ``fewest`` times or more.

*Edge cases.* A missing text has no words; a missing id is the empty text before the colon. Runs may be as long as a text:
no prefix is ever written out. Repeated rows count each time. No words, no rows. Only the id and text columns are read. A
subtrie of more than 2^28 nodes stops the job.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.columns import field
from patronage.llm.words import bytes_of, lean
from patronage.scratch import stored

SHORTEST, FEWEST, TIMES = 7, 2, 10
DROPPED = 31
# Letters that name a subtrie; letters of the alphabet take 7 bits.
TOP, LETTER_BITS, NUMBER_BITS = 5, 7, 28
# Distinct words and bytes of them that a task holds before it hands them on.
HELD, HELD_BYTES = 200_000, 1 << 25
# The n of a form is 10 times that of the word or more and below 2^63, so 18 steps lead to the last form; five doublings do 32.
DOUBLINGS = 5


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST,
             fewest: int = FEWEST) -> DataFrame:
    """(word, n): the words of all texts with their occurrences."""
    rows = docs.select(F.concat(F.coalesce(field(id).cast("string"), F.lit("")), F.lit(":")).alias("id"), field(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        letters = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)
        held, size = {}, 0

        def handed():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            heads = batch.column(0).to_pylist()
            data, offsets = bytes_of(batch.column(1))
            for i, head in enumerate(heads):
                # bytes.lower() changes A-Z only.
                body = data[offsets[i]:offsets[i + 1]].tobytes().lower().decode()
                seen = {}
                for w in letters.findall(body):
                    seen[w] = seen.get(w, 0) + 1
                start = zlib.crc32(head.encode())
                for w, n in seen.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % DROPPED == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < shortest:
                            continue
                    if w in held:
                        held[w] += n
                    else:
                        held[w] = n
                        size += len(w)
                if len(held) >= HELD or size >= HELD_BYTES:
                    yield handed()
                    held, size = {}, 0
        if held:
            yield handed()

    counted = rows.mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def _letters(word: str) -> np.ndarray:
    """Letters as numbers from 1 in code-point order: a-z, then U+00C0 to U+00FF."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 0xC0, points - 96, points - 0xC0 + 27)


class Subtries:
    """Numbers the trie nodes of words that come subtrie by subtrie, each in order."""

    def __init__(self):
        self.before, self.nodes, self.subtrie, self.next = np.zeros(0, np.int64), np.zeros(0, np.int64), -1, 0

    def add(self, letters: np.ndarray) -> np.ndarray:
        """Nodes after 0, 1, 2, ... letters of the next word."""
        n = len(letters)
        top = np.zeros(TOP + 1, np.int64)
        for d in range(TOP):  # upper nodes are their letters, padded on the right
            top[d + 1] = top[d] | letters[d] << LETTER_BITS * (TOP - 1 - d)
        if top[TOP] != self.subtrie:
            self.subtrie, self.next, self.before = top[TOP], 0, np.zeros(0, np.int64)
        short = min(n, len(self.before))
        unlike = np.flatnonzero(letters[:short] != self.before[:short])
        shared = max(int(unlike[0]) if len(unlike) else short, TOP)
        nodes = np.empty(n + 1, np.int64)
        # Number 0 is for the letters of the subtrie themselves; -1 - d and the letters for the nodes above.
        nodes[:TOP] = -1 - (top[:TOP] * (TOP + 1) + np.arange(TOP))
        nodes[TOP] = top[TOP] << NUMBER_BITS
        if shared > TOP:
            nodes[TOP + 1:shared + 1] = self.nodes[TOP + 1:shared + 1]
        fresh = n - shared
        if self.next + fresh >= 1 << NUMBER_BITS:
            raise OverflowError("a subtrie has too many nodes")
        nodes[shared + 1:] = nodes[TOP] + self.next + 1 + np.arange(fresh)
        self.next += fresh
        self.before, self.nodes = letters, nodes
        return nodes


def _forward(words: DataFrame) -> DataFrame:
    """Adds ``id``, the word's node in the trie, and ``nodes``, those of all its prefixes as 8 bytes each."""
    def run(batches):
        lean()
        trie = Subtries()
        for batch in batches:
            nodes = [trie.add(_letters(w)) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([x[-1] for x in nodes], pa.int64()),
                                   pa.array([x.tobytes() for x in nodes], pa.binary())], names=["word", "n", "id", "nodes"])

    dealt = words.select("word", "n").repartition(F.substring("word", 1, TOP)).sortWithinPartitions("word")
    return dealt.mapInArrow(run, "word string, n long, id long, nodes binary")


# What a row says about its pair: the word is whole, or lacks a letter (one that is followed by an equal one, or not).
WHOLE, REPEATED, SINGLE = 0, 1, 2


def _pairs(forward: DataFrame) -> DataFrame:
    """(left, right, kind, id, n): for each word the pairs of nodes around each letter and around each gap."""
    def run(batches):
        lean()
        trie = Subtries()
        for batch in batches:
            columns = [[] for _ in range(4)]
            held = 0

            def handed():
                left, right, kind, own = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
                return pa.record_batch([pa.array(left), pa.array(right), pa.array(kind.astype(np.int8)),
                                        pa.array(own[:, 0] if len(own) else own), pa.array(own[:, 1] if len(own) else own)],
                                       names=["left", "right", "kind", "id", "n"])

            for word, n, own, packed in zip(*(c.to_pylist() for c in batch.columns[1:])):
                letters = _letters(word)[::-1]
                after = trie.add(letters)[::-1]  # after[i]: node of the letters from i on
                before = np.frombuffer(packed, np.int64)
                letters = letters[::-1]
                size = len(letters)
                single = np.append(letters[1:] != letters[:-1], True)
                columns[0] += [before[:size], before]
                columns[1] += [after[1:], after]
                columns[2] += [np.where(single, SINGLE, REPEATED), np.full(size + 1, WHOLE)]
                columns[3].append(np.repeat(np.array([[own, n]], np.int64), 2 * size + 1, axis=0))
                held += 2 * size + 1
                if held >= 1 << 18:
                    yield handed()
                    columns, held = [[] for _ in range(4)], 0
            if held:
                yield handed()

    turned = F.reverse("word")
    dealt = forward.select(turned.alias("turned"), "word", "n", "id", "nodes").repartition(F.substring("turned", 1, TOP)) \
        .sortWithinPartitions("turned")
    return dealt.mapInArrow(run, "left long, right long, kind byte, id long, n long")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, near, best): each word's number of near words, and the best of them as (n, -id)."""
    rank = F.struct("n", (-F.col("id")).alias("minus"))
    member = F.struct(rank.alias("rank"), "kind")
    # At most one word per letter of the alphabet and one whole word share a pair.
    groups = pairs.groupBy("left", "right").agg(F.collect_list(member).alias("all"), F.max("kind").alias("most")).where(
        (F.size("all") > 1) & (F.col("most") > WHOLE))
    lacking = F.sort_array(F.filter("all", lambda m: m["kind"] != WHOLE), asc=False)
    groups = groups.select(lacking.alias("lacking"), F.filter("all", lambda m: m["kind"] == WHOLE).alias("whole"))
    single = F.filter("lacking", lambda m: m["kind"] == SINGLE)
    groups = groups.select("lacking", F.get("whole", F.lit(0)).alias("whole"), single.alias("single"))

    def of_lacking(m):
        other = F.when(F.element_at("lacking", 1)["rank"] == m["rank"], F.get("lacking", F.lit(1))["rank"]).otherwise(
            F.element_at("lacking", 1)["rank"])
        joined = (m["kind"] == SINGLE) & F.col("whole").isNotNull()
        return F.struct(m["rank"]["minus"].alias("minus"), (F.size("lacking") - 1 + joined.cast("int")).alias("near"),
                        F.greatest(other, F.when(joined, F.col("whole")["rank"])).alias("best"))

    of_whole = F.when(F.col("whole").isNotNull(), F.array(F.struct(
        F.col("whole")["rank"]["minus"].alias("minus"), F.size("single").alias("near"),
        F.get("single", F.lit(0))["rank"].alias("best")))).otherwise(F.array())
    found = groups.select(F.explode(F.concat(F.transform("lacking", of_lacking), of_whole)).alias("m")).select("m.*")
    return found.where(F.col("near") > 0).groupBy((-F.col("minus")).alias("id")).agg(
        F.sum("near").cast("long").alias("near"), F.max("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(id, root) from (id, next): where following ``next`` ends. Chains have at most 2^``DOUBLINGS`` links."""
    now = links.select("id", F.col("next").alias("root"))
    for k in range(DOUBLINGS):
        now = stored(now, f"roots-{k}")
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        far = now.join(ahead, "root", "left")
        if far.where(F.col("further").isNotNull()).isEmpty():
            break
        now = far.select("id", F.coalesce("further", "root").alias("root"))
    return now


def spelling_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, fewest: int = FEWEST,
                    times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    ``form`` is the near word of largest n, the smallest of equal ones, if its n is ``times`` times that of the word or more;
    ``root`` is the last word on the way from form to form.
    """
    if shortest <= TOP:
        raise ValueError(f"words need more than {TOP} letters")
    forward = stored(_forward(variants(docs, id, text, shortest, fewest)), "words")
    near = stored(neighbours(_pairs(forward)), "neighbours")
    links = stored(forward.select("id", "n").join(near, "id").where(F.col("best.n") >= times * F.col("n")).select(
        "id", (-F.col("best.minus")).alias("next"), F.col("best.n").alias("form_n")), "forms")
    names = forward.select("id", "word")
    ends = links.join(roots(links), "id").join(names.select(F.col("id").alias("next"), F.col("word").alias("form")), "next").join(
        names.select(F.col("id").alias("root"), F.col("word").alias("last")), "root").select("id", "form", "form_n", "last")
    return forward.select("word", "n", "id").join(near.select("id", "near"), "id", "left").join(ends, "id", "left").select(
        "word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("near", F.lit(0).cast("long")).alias("n_near"),
        "form_n")
