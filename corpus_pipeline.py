"""A training corpus from ``documents``: each stage takes what the one before it kept, written as Parquet and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import byte_bpe, decontamination, near_dedup, quality_rules, queries, substring_dedup
from patronage.llm.ids import fresh
from patronage.scratch import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by its own text."""
    return quality_rules.without_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents of which nothing is left go."""
    words, gone = fresh(docs, "_words"), fresh(docs, "_cut")
    cut = substring_dedup.without_repeats(docs, counts=(words, gone))
    return cut.where(F.col(words) > F.col(gone)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids; decoding must give back every text, else the job stops."""
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2("text", 256).alias("sha"))
    coded = byte_bpe.encode(rows, queries.RANKS, queries.PATTERN)
    back = byte_bpe.decode(coded, queries.RANKS)
    right = F.sha2("bytes", 256).eqNullSafe(F.coalesce("sha", F.sha2(F.lit(""), 256)))
    ids = F.when(right, F.col("token_ids")).otherwise(
        F.raise_error(F.concat(F.lit("Decoding does not give back document "), F.coalesce(
            F.col("doc_id").cast("string"), F.lit("without id")))).cast("array<int>"))
    return back.select("doc_id", "lang", "source", ids.alias("token_ids"), F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

# Near copies, histogram distances and byte-pair merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
