"""Exact length histogram: how many tokens a corpus holds, as a whole and under every context limit.

Method. Documents are counted by encoded length. With counts d(l), suffix sums over the lengths answer, for any limit c:
documents of at least c tokens, tokens kept when every document is truncated to c (the sum over l of min(l, c) d(l)),
tokens lost, and, by ranks, quantiles. The histogram is exact; nothing is estimated.

The histogram has a row per distinct length, so its size follows the longest document, not the number of documents. Sums
over it run in blocks of ``BLOCK`` lengths: totals of blocks first, then within each block, so no window holds it all.

Edge cases. Null and empty texts have length 0 and are counted. Repeated rows count as often as they occur. An empty table
gives an empty histogram, for which every limit has totals of 0 and null quantiles. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patronage.columns import field, require_columns
from patronage.errors import InputProblem
from patronage.llm import byte_bpe
from patronage.llm.ids import fresh
from patronage.scratch import stored

BLOCK = 1024


def token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of ``text`` in place of ``text``."""
    ids = fresh(docs, "_ids")
    coded = byte_bpe.encode(docs, path, pattern, text, ids)
    return coded.withColumn(n_tokens, F.size(ids).cast("long")).drop(ids)


def histogram(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Per distinct length: n_tokens, documents, and the sums over the histogram.

    ``documents_up_to`` and ``tokens_up_to`` count this length and shorter ones, ``documents_from`` and ``tokens_from`` this
    one and longer ones; ``truncated_total`` is what is left of the corpus when texts are cut to this length.
    """
    require_columns(lengths, n_tokens)
    # Written: the sums below read the histogram twice, and texts must be encoded once.
    counts = stored(lengths.where(field(n_tokens).isNotNull()).groupBy(
        field(n_tokens).cast("long").alias("n_tokens")).agg(F.count("*").alias("documents")), "lengths")
    rows = counts.withColumns({"tokens": F.col("documents") * F.col("n_tokens"),
                               "block": F.floor(F.col("n_tokens") / BLOCK).cast("long")})
    totals = rows.groupBy("block").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    # One row per block of lengths: a thousandth of the longest document's tokens at most.
    up = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy("block").rowsBetween(1, W.unboundedFollowing)
    sums = totals.select("block", *[
        F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{side}")
        for c in ("d", "t") for side, w in (("below", up), ("above", down))])
    own = W.partitionBy("block").orderBy("n_tokens")
    upto, onward = own.rowsBetween(W.unboundedPreceding, 0), own.rowsBetween(0, W.unboundedFollowing)
    out = rows.join(sums, "block").select(
        "n_tokens", "documents", "tokens",
        (F.col("d_below") + F.sum("documents").over(upto)).alias("documents_up_to"),
        (F.col("t_below") + F.sum("tokens").over(upto)).alias("tokens_up_to"),
        (F.col("d_above") + F.sum("documents").over(onward)).alias("documents_from"),
        (F.col("t_above") + F.sum("tokens").over(onward)).alias("tokens_from"))
    shorter = F.col("tokens_up_to") - F.col("tokens")
    return out.withColumn("truncated_total", shorter + F.col("n_tokens") * F.col("documents_from"))


def under_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Per context limit: documents, tokens, documents over it, tokens kept and lost by truncation.

    Any limit is answered from the histogram, also one that no document has as its length. One aggregation over the
    histogram answers all limits.
    """
    if not limits or any(c < 0 for c in limits):
        raise InputProblem("Name at least one context limit, none below 0.")
    spark = sums.sparkSession
    wanted = sorted(set(int(c) for c in limits))
    over = [F.col("n_tokens") > c for c in wanted]
    cells = [F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")]
    for k, c in enumerate(wanted):
        cells.append(F.sum(F.when(over[k], F.col("documents"))).alias(f"o{k}"))
        cells.append(F.sum(F.least(F.col("n_tokens"), F.lit(c)) * F.col("documents")).alias(f"k{k}"))
    row = sums.agg(*cells)
    zero = F.lit(0).cast("long")
    per_limit = F.array(*[F.struct(
        F.lit(c).cast("long").alias("context_limit"), F.coalesce("documents", zero).alias("documents"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce(f"o{k}", zero).alias("documents_over"),
        F.coalesce(f"k{k}", zero).alias("tokens_kept")) for k, c in enumerate(wanted)])
    out = row.select(F.explode(per_limit).alias("r")).select("r.*")
    return out.withColumn("tokens_lost", F.col("tokens") - F.col("tokens_kept"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Per share: the smallest length that at least this share of the documents does not exceed (null without any)."""
    if any(not 0 <= s <= 1 for s in shares):
        raise InputProblem("Shares lie between 0 and 1.")
    total = F.col("documents_up_to") + F.col("documents_from") - F.col("documents")
    cells = [F.min(F.when(F.col("documents_up_to") >= F.lit(float(s)) * total, F.col("n_tokens"))).alias(f"q{k}")
             for k, s in enumerate(shares)]
    per_share = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("n_tokens"))
                          for k, s in enumerate(shares)])
    return sums.agg(*cells).select(F.explode(per_share).alias("r")).select("r.*")


def report(sums: DataFrame, limits: Sequence[int], shares: Sequence[float]) -> DataFrame:
    """The histogram and its answers as one table; ``kind`` says what a row is.

    ``length``: a row of the histogram. ``limit``: a context limit as n_tokens, with all documents and tokens, the documents
    over it, and the tokens kept (truncated_total) and lost. ``quantile``: a share of the documents and, as n_tokens, the
    length it does not exceed. Columns that a kind does not speak of are null.
    """
    under = under_limits(sums, limits).withColumnsRenamed({"context_limit": "n_tokens", "tokens_kept": "truncated_total"})
    kinds = {"length": sums, "limit": under, "quantile": quantiles(sums, shares)}
    named = [df.select(F.lit(kind).alias("kind"), "*") for kind, df in kinds.items()]
    return named[0].unionByName(named[1], allowMissingColumns=True).unionByName(named[2], allowMissingColumns=True)
