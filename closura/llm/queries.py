"""Registered queries of the corpus operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.llm import bpe, chat_format, collocations, decontaminate, hard_negatives, hmm, line_dedup, minhash, packing, quality, sharding, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"
END_OF_TEXT = 50_256  # free in that file
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op6_byte_bpe(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op8_quality_rules(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query
def op5_sharding(spark, sf):
    return sharding.place(table(spark, sf, "documents").select("doc_id"), SHARDS)


@query
def op9_token_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, END_OF_TEXT)


@query
def op1_decontamination(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("key")


@query
def op2_line_dedup(spark, sf):
    return line_dedup.dedup(table(spark, sf, "documents").select("doc_id", "text"), counts=True)


@query
def op10_toxicity(spark, sf):
    return toxicity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_hmm_scoring(spark, sf):
    return hmm.score(table(spark, sf, "documents"))


@query
def op7_minhash_near_dedup(spark, sf):
    return minhash.judge(table(spark, sf, "documents")).drop("key")


@query
def op4_url_filter(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


@query
def op11_hard_negatives(spark, sf):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH used AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
           list_sum([z[1] * z[2] FOR z IN list_zip(a.q, c.q)])::BIGINT AS score
    FROM used a JOIN used c ON a.vec_id <> c.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE label = anchor_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER best ::INTEGER AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE s.label <> p.anchor_label AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 10
"""

PLANTED = "\\### Assistant: </turn> ok"


@query
def op12_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], turns.schema)
    return chat_format.digest(chat_format.windows(turns.unionByName(planted)))


ORACLES["op12_chat_format"] = """
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS rank,
           count(*) OVER (PARTITION BY conv_id) AS n,
           len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS size,
           length('### : </turn>') + 1
             + length(replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#'), ': ', ':\\ '))
             + length(replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#')) AS chars
    FROM given
), systems AS (
    SELECT conv_id, size, chars FROM placed WHERE role = 'system' AND rank = 1 AND n > 1
), summed AS (
    SELECT p.conv_id, p.rank, p.size, p.chars, coalesce(s.size, 0) AS system_size, coalesce(s.chars, 0) AS system_chars,
           sum(p.size) OVER (PARTITION BY p.conv_id ORDER BY p.rank)::BIGINT AS stop
    FROM placed p LEFT JOIN systems s ON s.conv_id IS NOT DISTINCT FROM p.conv_id
    WHERE NOT (p.role = 'system' AND p.rank = 1 AND p.n > 1)
), celled AS (
    SELECT *, stop - size AS start, greatest(1024 - 256 - system_size, 1) AS room,
           (stop - size) // greatest(1024 - 256 - system_size, 1) AS cell
    FROM summed
), split AS (
    SELECT *, max(stop) OVER c - min(start) OVER c > room AND stop > (cell + 1) * room AS alone
    FROM celled WINDOW c AS (PARTITION BY conv_id, cell)
), wins AS (
    SELECT conv_id, cell, alone, min(start) AS start, any_value(room) AS room, any_value(system_chars) + sum(chars) AS chars
    FROM split GROUP BY ALL
), full_wins AS (
    SELECT w.conv_id, w.cell, w.alone, any_value(w.chars) + coalesce(sum(h.chars), 0) AS chars
    FROM wins w LEFT JOIN celled h
      ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.stop <= w.start AND h.start >= w.start - least(256, w.room)
    GROUP BY ALL
), texts AS (
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rank)) AS turns_sha256,
           coalesce(string_agg(text, '' ORDER BY rank) FILTER (role = 'assistant'), '') AS learned
    FROM placed GROUP BY conv_id
)
SELECT t.conv_id, t.n_turns, t.turns_sha256, length(t.learned)::BIGINT AS loss_chars, sha256(t.learned) AS loss_sha256,
       sum(w.chars)::BIGINT AS formatted_chars, count(*) AS n_windows
FROM texts t JOIN full_wins w ON w.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY ALL
"""


@query
def op13_phrase_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


ORACLES["op13_phrase_collocations"] = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), pieces AS (
    SELECT lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\f\r]')) AS piece FROM texts
), listed AS (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), phrases AS (
    SELECT lang, 1 AS words, unnest(w) AS phrase FROM listed
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM listed
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM listed
), counts AS (
    SELECT lang, words, phrase, count(*) AS f FROM phrases GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), candidates AS (
    SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS p FROM counts WHERE words > 1 AND f >= 10
), cuts AS (
    SELECT lang, words, phrase, a, unnest(range(1, words)) AS k, p FROM candidates
), parts AS (
    SELECT lang, words, phrase, a, k, array_to_string(p[:k], ' ') AS head, array_to_string(p[k + 1:], ' ') AS tail FROM cuts
), scored AS (
    SELECT c.lang, c.words, c.phrase, c.a, x.f AS l, y.f AS r,
           ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM parts c
    JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), inner_pairs AS (
    SELECT lang, a AS longer, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase
    FROM candidates WHERE words = 3
), gone AS (
    SELECT c.lang, c.phrase FROM candidates c JOIN inner_pairs i USING (lang, phrase) WHERE 100 * i.longer >= 50 * c.a
)
SELECT s.lang, row_number() OVER best AS rank, s.phrase, s.a, s.l, s.r, t.n, s.score
FROM scored s JOIN totals t USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.lang = s.lang AND g.phrase = s.phrase)
WINDOW best AS (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase)
QUALIFY row_number() OVER best <= 2000
"""

QUERIES["pipeline"] = corpus_pipeline.run
