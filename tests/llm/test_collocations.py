import re
from collections import Counter
from functools import partial

import numpy as np
import pytest

from closura.llm import collocations
from closura.llm.queries import QUERIES

COLS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(docs, support=10, longest=3, percent=50, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    found = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= support}
    gone = set()
    for (lang, p), f in found.items():
        for n in range(2, len(p)):
            gone |= {(lang, p[i : i + n]) for i in range(len(p) - n + 1) if 100 * f >= percent * found[lang, p[i : i + n]]}
    rows = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cut = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            l, r = counts[lang, p[: cut[1]]], counts[lang, p[cut[1] :]]
            rows.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, totals[lang], -score)
        for lang, some in rows.items()
        for i, (score, a, p, l, r) in enumerate(sorted(some)[:top])
    )


def rows(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", "clash") for d in docs], "text string, lang string, phrase string, words string").repartition(3)


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "C", "dé", "e\x00", "日本", "zz"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", " \x0b"]
    odds = [0.5, 0.15, 0.15, 0.05, 0.05, 0.05, 0.05]
    return [
        ("".join(str(rng.choice(words)) + str(rng.choice(marks, p=odds)) for _ in range(rng.integers(0, 60))), [None, "en", "und"][i % 3])
        for i in range(n)
    ]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()
    assert rows(QUERIES["op13_phrase_collocations"](spark, sf)) == brute(docs)


@pytest.mark.parametrize("setting", [{}, {"CHUNK_BYTES": 50, "PENDING": 40, "BUCKET_BYTES": 100}, {"TOP_SALT": 1}])
def test_chunks_shards_and_odd_words(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(collocations, name, value)
    docs = sample(80)
    for shards, top, support in ((1, 2000, 10), (4, 7, 3), (50, 5, 20)):
        assert rows(collocations.collocations(frame(spark, docs), support=support, top=top, shards=shards)) == brute(docs, support, top=top)


def test_longer_phrases_and_a_full_filter(spark, monkeypatch):
    docs = sample(60, 2)
    assert rows(collocations.collocations(frame(spark, docs), longest=4, percent=30)) == brute(docs, longest=4, percent=30)
    monkeypatch.setattr(collocations, "phrase_counts", partial(collocations.phrase_counts, filter_bits=7))  # nearly all phrases pass
    assert rows(collocations.collocations(frame(spark, docs))) == brute(docs)


def test_equal_hashes_do_not_join_phrases(spark, monkeypatch):
    """Only three hash values in the first place: shards and filter let everything pass, words still decide."""
    true = collocations.Chunk.hashes
    monkeypatch.setattr(collocations.Chunk, "hashes", lambda self, which, n: [h % np.uint64(3) if which == 0 else h for h in true(self, which, n)])
    texts = [t.encode() for t, _ in sample(40, 3)]
    chunk = collocations.Chunk("en", texts)
    got = Counter()

    class Full:
        value = b"\xff" * 16

    import pyarrow as pa

    batch = pa.table({"shard": [0] * len(texts), "lang": ["en"] * len(texts), "text": [t.decode() for t in texts]}).to_batches()[0]
    for r in (r for b in collocations._count(3, 7, Full)(iter([batch])) for r in b.to_pylist() if r["words"]):
        got[r["phrase"]] += r["f"]
    want = Counter()
    for n in (1, 2, 3):
        want.update(chunk.phrases(chunk.within(n), n).to_pylist())
    assert got == want


def test_odd_rows(spark):
    long = "x y " * 200_000
    docs = [(None, "en"), ("", None), (" \t\n.", "de"), (long, "en"), ("one two three. one two", None)] + [("Ab cd, EF", "fr")] * 11
    assert rows(collocations.collocations(frame(spark, docs))) == brute(docs)
    assert collocations.collocations(frame(spark, docs).limit(0)).collect() == []
