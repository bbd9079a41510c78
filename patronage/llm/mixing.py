"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to ``most`` times. A stretch of words that ends at
the c-th word of its queue has the virtual finish time c / target of the source: all queues reach 1 when each has given its
target. The stretches of all queues are sorted over the whole table by finish time, and the mix ends where the total budget
is used up. A document in which its source's target is reached is two stretches, so a source misses its target by less than
one word.

*Budget and targets.* The sources, by code point and with the missing one last, weigh ``weights`` in turn and share
``percent`` / 100 of all words by weight. A source's target stops at ``most`` times its words; what is above goes to the
others by weight, until none is above.

*Shuffle.* Documents are in the order of the MD5 of id and text. Its first digits name one of 4,096 slices of a queue; sums
per slice give where it starts, so a source that holds most rows is summed in slices, never in one task. The sort splits equal
finish times too; the driver sees one sum per part of the sort and one row of sums per round of sharing.

*Edge cases.* A word is a maximal run of other characters than 0x20 and 0x09-0x0D; no text means no words. A document without
words is listed with 0 taken. A missing source is a source. Missing and repeated ids are separate documents; rows
that agree in id, text and source are interchangeable. An empty table gives an empty mix. Only the id, text and source columns
are read, so other columns may have any name.

All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.columns import field
from patronage.operators.ranking import ROW_BITS, distributed_rank
from patronage.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
# Hexadecimal digits of the shuffle key that name a slice: 16^3 slices of each queue.
DIGITS = 3


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, size, key, slice) of every document: its words, and its place in the shuffle."""
    key = F.md5(F.concat(F.coalesce(field(id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(field(text), F.lit(""))))
    rows = docs.select(field(id).alias("id"), field(source).alias("source"), key.alias("key"),
                       F.coalesce(F.regexp_count(field(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("slice", F.substring("key", 1, DIGITS))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    turn = F.array(*[F.lit(int(w)) for w in weights])
    ranked = distributed_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    ranked = ranked.withColumn("_weight", F.get(turn, ((F.col("_rank") - 1) % len(weights)).cast("int"))) \
        .withColumn("_most", F.col("source_size") * most)
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    budget = percent / 100 * (whole["size"] or 0)
    full, weight, level = 0, whole["weight"] or 0, 0.0
    while weight:
        level = (budget - full) / weight
        above = F.col("_most") <= F.col("_weight") * F.lit(level)
        now = ranked.agg(F.coalesce(F.sum(F.when(above, F.col("_most"))), F.lit(0)).alias("full"),
                         F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0)).alias("weight")).first()
        if (now["full"], now["weight"]) == (full, weight):
            break
        full, weight = now["full"], now["weight"]
    target = F.least(F.col("_most").cast("double"), F.col("_weight") * F.lit(level))
    if not weight:  # no source has words left to give
        target = F.col("_most").cast("double")
    return ranked.select("source", "source_size", target.alias("target"))


def _pieces(most: int) -> Column:
    """The stretches of a document: for each pass the words up to its source's target and those after it."""
    out = []
    for turn in range(most):
        start = F.col("source_size") * turn + F.col("end") - F.col("size")
        inside = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("whole") - start))
        for at, words in ((start, inside), (start + inside, F.col("size") - inside)):
            finish = (at + words) / F.nullif(F.col("whole"), F.lit(0))
            out.append(F.struct(F.lit(turn).alias("turn"), at.alias("start"), words.alias("words"), finish.alias("virtual_finish"),
                                F.lit(not out).alias("first")))
    # The first stretch stands for a document that gives nothing.
    return F.filter(F.array(*out), lambda p: (p["words"] > 0) | p["first"])


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST,
            id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix: one row per stretch of a document, with how many of its words are taken.

    Columns: id, source, slice, place (the three last name the row of the document), size, source_size, target, turn (0 for the
    first pass), start (words of the queue before the stretch), words, virtual_finish, taken. The rows
    in order of (virtual_finish, source, start) are the mix; those after the budget take 0.
    """
    rows = stored(sized(docs, id, text, source).withColumn(
        "queue", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), "sized")
    slices = stored(rows.groupBy("queue", "slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source")),
                    "slices")
    per_source = slices.groupBy("queue").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size"))
    goals = targets(per_source.select("source", "source_size"), weights, percent, most).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("queue"), "source_size", "target",
        F.floor("target").alias("whole"))
    # At most 4,096 rows for each source.
    before = F.sum("slice_size").over(W.partitionBy("queue").orderBy("slice")) - F.col("slice_size")
    begins = slices.select("queue", "slice", before.alias("before")).join(goals, "queue")
    in_slice = W.partitionBy("queue", "slice").orderBy("key", "id", "size")
    so_far = F.sum("size").over(in_slice.rowsBetween(W.unboundedPreceding, W.currentRow))
    queued = rows.join(begins, ["queue", "slice"]).withColumns({
        "place": F.row_number().over(in_slice), "end": F.col("before") + so_far})
    pieces = queued.select("id", "source", "queue", "slice", "place", "size", "source_size", "target", "whole",
                           F.explode(_pieces(most)).alias("p")).select("*", "p.*").drop("p", "first")
    return _truncated(pieces, goals.agg(F.sum("whole")).first()[0] or 0).drop("queue", "whole")


def _truncated(pieces: DataFrame, budget: int) -> DataFrame:
    """Adds ``taken``: the words of the first ``budget`` words in the order of finish times."""
    ordered = pieces.orderBy("virtual_finish", "queue", "start").withColumn("_row", F.monotonically_increasing_id())
    part = F.shiftright("_row", ROW_BITS)
    ordered = stored(ordered, "mix")
    # One row per part of the sort; the budget ends within one of them.
    begins, left = budget, None
    for p in ordered.groupBy(part.alias("part")).agg(F.sum("words").alias("words")).orderBy("part").collect():
        if begins < p["words"]:
            left = p["part"]
            break
        begins -= p["words"]
    if left is None:
        return ordered.withColumn("taken", F.col("words")).drop("_row")
    whole = ordered.withColumn("taken", F.when(part < left, F.col("words")).otherwise(F.lit(0).cast("long"))).where(part != left)
    earlier = F.sum("words").over(W.partitionBy(part).orderBy("_row")) - F.col("words")
    cut = ordered.where(part == left).withColumn(
        "taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.lit(begins) - earlier)))
    return whole.unionByName(cut).drop("_row")


def taken(mix: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row per document: id, size, source_size, target, taken over all its passes."""
    by = mix.groupBy("source", "slice", "place").agg(
        F.first("id").alias(id), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("taken").alias("taken"))
    return by.select(field(id), "size", "source_size", "target", "taken")
