import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from closura.llm import decontaminate, line_dedup, minhash, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_result(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    calls = {
        "toxicity": lambda d: toxicity.judge(d, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0"),
        "near_dedup": lambda d: minhash.judge(d).where("kept"),
        "decontamination": lambda d: decontaminate.report(d, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == COLUMNS and 0 < after.count() <= docs.count()
        ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
        if name in calls:
            assert ids(after) == ids(calls[name](docs))
            assert after.join(docs, COLUMNS).count() == after.count()  # rows unchanged
        else:
            texts = dict(line_dedup.dedup(docs).select("doc_id", "text").collect())
            assert dict(after.select("doc_id", "text").collect()) == {i: t for i, t in texts.items() if t and t.split()}
        docs = after
    before = spark.conf.get(corpus_pipeline.BATCH_ROWS)
    spark.conf.set(corpus_pipeline.BATCH_ROWS, 777)
    out = corpus_pipeline.run(spark, sf).collect()
    assert spark.conf.get(corpus_pipeline.BATCH_ROWS) == "777"
    spark.conf.set(corpus_pipeline.BATCH_ROWS, before)
    want = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("k", range(4))
def test_stages_take_odd_rows(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(3).withColumns({"key": F.lit("clash"), "n": F.lit(1)})
    odd = docs.union(docs).union(docs.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    out = corpus_pipeline.STAGES[k][1](spark, odd, sf)
    assert out.columns == odd.columns and out.where("text IS NULL").count() == 3
    assert corpus_pipeline.STAGES[k][1](spark, odd.limit(0), sf).collect() == []


def test_encoding_takes_odd_rows_and_very_long_texts(spark, sf):
    texts = [None, "", "word " * 300_000, "x" * 100_000, "x" * 100_000]
    docs = spark.createDataFrame([(i % 4, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf).collect()
    want = sorted((i % 4, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in out) == want
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), sf).collect() == []
