"""One query per operator of this subpackage over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import (byte_bpe, collocations, decontamination, language_id, lengths, mixing, near_dedup, packing,
                           perplexity, quality_rules, spelling, substring_dedup, toxicity)

# The vocabulary of the queries; operators take the path as an argument.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Context limits and shares of the documents that the length report answers.
LIMITS = [128, 512, 1024, 2048, 4096, 8192, 32768]
SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _with_digest(df: DataFrame, text: str, digest: str) -> DataFrame:
    """``text`` replaced by the SHA-256 of its words joined by one blank."""
    others = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            words = batch.column(batch.num_columns - 1).cast(pa.binary())
            hashed = [hashlib.sha256(b" ".join((t.as_py() or b"").split())).hexdigest() for t in words]
            yield pa.record_batch([*batch.columns[:-1], pa.array(hashed, pa.string())],
                                  names=[*batch.schema.names[:-1], digest])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return df.select(*[f"`{f.name}`" for f in others], text).mapInArrow(run, f"{schema}, `{digest}` string")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judged(_table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    unseen = language_id.held_out(F.col("doc_id"))
    found = language_id.predicted(docs, docs.where(~unseen))
    return found.select("doc_id", unseen.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    part = toxicity.fold(F.col("id"))
    found = toxicity.scored(docs, labels, learn=part.isin(0, 1), calibrate=part == 3)
    return found.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judged(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op5_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    cut = substring_dedup.without_repeats(docs, counts=("n_words", "n_removed"))
    return _with_digest(cut, "text", "kept_sha256")


def op6_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_packed_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return packing.digest(packing.packed(byte_bpe.encode(docs, RANKS, PATTERN)))


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op10_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lengths.report(lengths.histogram(lengths.token_counts(docs, RANKS, PATTERN)), LIMITS, SHARES)


def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(mixing.mixture(_table(spark, folder, "documents")))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op13_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_perplexity": op4_perplexity,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_benchmark_leaks": op6_benchmark_leaks,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_packed_rows": op8_packed_rows,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_length_histogram": op10_length_histogram,
    "op11_source_mix": op11_source_mix,
    "op12_collocations": op12_collocations,
    "op13_spelling_groups": op13_spelling_groups,
}

# Words and shingles as in the operators; the others are beyond SQL and are tested against plain computations.
WORD = r"[^ \t\n\x0b\f\r]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_sql(table: str, key: str) -> str:
    """Distinct (key, shingle) of a table's texts."""
    words = f"regexp_extract_all({LOWER.format('text')}, '{WORD}')"
    return f"""SELECT DISTINCT {key}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                  ELSE array_to_string(w[i:i + 4], ' ') END AS s
        FROM (SELECT {key}, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i
              FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"""


SQL: dict[str, str] = {
    "op5_repeated_passages": f"""
WITH word AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM word WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + g AS i FROM later, generate_series(0, 19) AS s(g)),
each AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM word)),
left_over AS (SELECT e.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text
              FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY ALL)
SELECT word.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM word LEFT JOIN left_over USING (doc_id)""",
    "op6_benchmark_leaks": f"""
WITH doc AS ({_shingle_sql("documents", "doc_id")}),
item AS ({_shingle_sql("benchmark", "item_id")}),
size AS (SELECT item_id, count(*) AS n_item_shingles FROM item GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared
FROM doc JOIN item USING (s) JOIN size USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 75 * n_item_shingles""",
    "op9_near_duplicates": f"""
WITH RECURSIVE doc AS MATERIALIZED ({_shingle_sql("documents", "doc_id")}),
size AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY ALL),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM doc a JOIN doc b ON a.s = b.s AND a.doc_id < b.doc_id
         GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
                      WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM way UNION SELECT r.x, w.y FROM reach r JOIN way w ON r.y = w.x),
root AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN root USING (doc_id)""",
    "op11_source_mix": f"""
WITH doc AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k,
                    coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r
        FROM doc GROUP BY source),
weighed AS (SELECT *, CASE r % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w, 1.5 * sum(source_size) OVER () AS budget FROM src),
-- Sources whose two passes are the least for their weight are the first to reach them.
level AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
                 sum(w) OVER (ORDER BY source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM weighed),
open AS (SELECT first(CAST(budget - full_before AS DOUBLE) / w_left ORDER BY source_size / w, r) AS height FROM level
         WHERE 2 * source_size * CAST(w_left AS DOUBLE) > w * CAST(budget - full_before AS DOUBLE)),
goal AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), w * coalesce(height, CAST('infinity' AS DOUBLE))) AS target
         FROM weighed, open),
queue AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS give,
                 CAST(sum(size) OVER (PARTITION BY doc.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
          FROM doc JOIN goal ON doc.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(size, give - before)) + greatest(0, least(size, give - source_size - before)) AS taken
FROM queue""",
    "op12_collocations": f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang,
                      unnest(regexp_split_to_array({LOWER.format("text")}, '[.,;:!?\n\x0b\f\r]')) AS p FROM documents),
word AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM piece),
place AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM word),
total AS (SELECT lang, count(*) AS n FROM place GROUP BY ALL),
gram AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
         FROM place, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
cand AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM gram WHERE k > 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
           FROM cand, generate_series(2, 3) AS a(m), generate_series(1, 3) AS b(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_ n USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * f),
side AS MATERIALIZED (SELECT lang, phrase, f AS a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest
                      FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM kept)),
cut AS (SELECT c.lang, c.phrase, a, j, x.f AS l, y.f AS r, CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
        FROM side c JOIN gram x ON x.lang = c.lang AND x.phrase = head JOIN gram y ON y.lang = c.lang AND y.phrase = rest),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN total USING (lang) WHERE rank <= 2000""",
    # The CRC-32 over the bytes of "<doc_id>:<run>", from its table of 256 remainders.
    "op13_spelling_groups": r"""
WITH RECURSIVE bit AS (SELECT CAST(x AS BIGINT) AS x, CAST(x AS BIGINT) AS c, 0 AS k FROM generate_series(0, 255) AS s(x)
                       UNION ALL SELECT x, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY x) AS t FROM bit WHERE k = 8),
run AS (SELECT doc_id, run, count(*) AS m FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[a-zA-Z\x{00C0}-\x{00FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
byte AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run),
hashed AS (SELECT doc_id, run, m, xor(4294967295, list_reduce(
             list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
             lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS INT)], c >> 8))) AS h FROM byte, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
                     ELSE run END AS word, m FROM hashed),
word AS MATERIALIZED (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY ALL HAVING sum(m) >= 2),
gap AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
                     FROM (SELECT word, n, CAST(unnest(generate_series(1, length(word))) AS INT) AS i FROM word)),
joint AS MATERIALIZED (SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 1) AS tail
                       FROM (SELECT word, n, CAST(unnest(generate_series(0, length(word))) AS INT) AS i FROM word)),
pair AS (SELECT a.word AS x, b.word AS y, b.n FROM gap a JOIN gap b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM gap a JOIN joint b ON a.head = b.head AND a.tail = b.tail
         UNION SELECT a.word, b.word, b.n FROM joint a JOIN gap b ON a.head = b.head AND a.tail = b.tail),
near AS (SELECT x AS word, count(*) AS n_near, max(n) AS most, first(y ORDER BY n DESC, y) AS best FROM pair GROUP BY ALL),
link AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN best END AS form,
                             CASE WHEN most >= 10 * w.n THEN most END AS form_n FROM word w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS root, 0 AS k FROM link
         UNION ALL SELECT walk.word, link.form, k + 1 FROM walk JOIN link ON walk.root = link.word WHERE link.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM link JOIN (SELECT word, last(root ORDER BY k) AS root FROM walk GROUP BY ALL) USING (word)""",
}
