"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. toxicity: documents judged toxic go; labels are learned from the given ``labels`` table.
2. line_dedup: lines that repeat an earlier line of the corpus, exactly or one word off, go; documents
   that had words and lose them all go with them.
3. near_dedup: one document of each group of near copies stays.
4. decontamination: documents contaminated by ``benchmark`` go.
5. byte_bpe: every remaining text is encoded and decoded; returns counts and digests.

All but the last return the columns of their input, clashing ones (``key``, ``n``) included.

Defined results: a document with null text stays to the end and encodes as empty text; rows with the same doc_id are
one document to line_dedup; rows with equal doc_id and text share their fate in every stage; of equal texts the one with the
least doc_id stays, and all with none; very long texts are worked on whole; an empty table passes through empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from closura.session import scratch_dir

RANKS = "byte_bpe_multi_50k.tiktoken"
BATCH_ROWS, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def _short_batches(spark: SparkSession) -> None:
    """Documents are long rows: fewer of them at a time between the JVM and Python. A stage is lazy, so the
    setting has to outlast it; ``run`` puts back what it found."""
    spark.conf.set(BATCH_ROWS, ARROW_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    word = F.lit("[^\\x20\\x09-\\x0D]")
    had = docs.withColumn("__had_words", F.coalesce(docs["text"].rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    left = line_dedup.dedup(had)
    return left.where(~F.col("__had_words") | F.regexp_like("text", word)).drop("__had_words")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return minhash.dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", byte_bpe_stage),
]

ORACLE_SQL = None  # learned scores, near copies and BPE are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return docs
