import collections
import itertools
import math
import zlib
from pathlib import Path

import numpy as np
import pytest

from closura.llm import hmm, wordhash
from closura.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def is_held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute_base(docs):
    counts = collections.Counter()
    for doc, text in docs:
        if not is_held(doc):
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(is_held(d), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in tokens(t))) for d, t in docs]


def check_base(rows, docs):
    want = {}
    for (doc, _), w in zip(docs, brute_base(docs), strict=True):
        want.setdefault(doc, []).append(w)
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
    assert got.keys() == want.keys()
    for doc in want:
        for g, w in zip(sorted(got[doc]), sorted(want[doc]), strict=True):
            assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)


def test_query_base_is_exact_and_model_beats_it_on_held_out_texts(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op3_hmm_scoring"](spark, sf).collect()
    check_base(rows, docs)
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize(("head_size", "symbols"), [(262_144, 16_384), (3, 2), (0, 5)])
def test_odd_rows_and_small_heads(spark, head_size, symbols):
    docs = [(i, f"the cat {'sat' if i % 2 else 'ran'} on mat{i % 5}") for i in range(30)]
    docs += [(100, None), (101, ""), (None, "no id here"), (102, "A\x0ba\x0ca É é"), (103, "w " * 70_000), (1, "the cat sat on mat1"), (1, "other text")]
    df = spark.createDataFrame([(d, t, "k", 0.5) for d, t in docs], "doc_id long, text string, symbols string, score double").repartition(3)
    rows = hmm.score(df, states=2, rounds=2, head_size=head_size, symbols=symbols).collect()
    check_base(rows, docs)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert hmm.score(df.limit(0)).collect() == []


def model(rng, symbols, states):
    part = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return hmm.Model(part(2, states), part(states, states), np.vstack([part(states, symbols).T, np.ones(states)]))


def paths(m, text, start):
    for states in itertools.product(range(len(m.move)), repeat=len(text)):
        p = m.start[start][states[0]] * m.emit[text[0]][states[0]]
        for a, b, x in zip(states, states[1:], text[1:]):
            p *= m.move[a][b] * m.emit[x][b]
        yield states, p


def test_forward_and_expected_counts_equal_enumeration():
    rng = np.random.default_rng(5)
    m = model(rng, 4, 3)
    texts = [rng.integers(0, 4, n).astype(np.uint16) for n in (5, 1, 3)]
    brute = [math.log10(sum(p for _, p in paths(m, t, 0))) for t in texts]
    assert hmm.log_likelihoods(m, texts) == pytest.approx(brute)
    segments, first = hmm.cut(texts, 4, 4)
    assert segments.tolist()[0] == texts[0][:4].tolist() and first.tolist() == [True, False, True, True]
    starts, moves, emits = np.zeros((2, 3)), np.zeros((3, 3)), np.zeros((4, 3))
    likelihood = 0
    for row, is_first in zip(segments, first):
        text = row[row < 4]
        total = sum(p for _, p in paths(m, text, 0 if is_first else 1))
        likelihood += math.log(total)
        for states, p in paths(m, text, 0 if is_first else 1):
            starts[0 if is_first else 1][states[0]] += p / total
            for a, b in zip(states, states[1:]):
                moves[a][b] += p / total
            for s, x in zip(states, text):
                emits[x][s] += p / total
    got = hmm.expected(m, segments, first)
    for have, want in zip(got, (starts, moves, emits, likelihood)):
        assert np.allclose(have, want, atol=1e-4)


def test_likelihood_rises_with_each_round(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["a", "b", "c"] if i % 2 else ["x", "y", "z"], 40))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    head, _ = hmm.head_of(hmm.vocabulary(df))
    coded = hmm.code(df, head)
    _, likelihoods = hmm.train(coded, np.array([400.0] * 6 + [0, 60]), 2, 6)
    assert all(b > a - 1e-3 * abs(a) for a, b in zip(likelihoods, likelihoods[1:]))


def test_word_hashes_follow_words():
    texts = [b"", b"  ", b"One two\x0bONE", "é É x\u00a0y".encode(), b"one"]
    h, bounds = wordhash.hashes(texts)
    words = [w for t in texts for w in t.lower().split()]
    assert np.diff(bounds).tolist() == [len(t.split()) for t in texts] and len(h) == len(words)
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_states_emit_words_beyond_the_shared_symbols(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join("xy"[i % 2] if k % 3 == 0 else f"{'ab'[i % 2]}{rng.integers(200)}" for k in range(60))) for i in range(300)]
    rows = hmm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), states=2, rounds=12, symbols=2).collect()
    for held in (False, True):  # a topic's words are half as many: log10(2) a token, of which x and y are a third
        some = [r for r in rows if r["held_out"] == held]
        assert sum(r["score"] - r["base_score"] for r in some) > 0.2 * sum(r["n_tokens"] for r in some)


def test_all_training_words_and_the_unknown_one_sum_to_one():
    rng = np.random.default_rng(4)
    counts = np.array([50.0, 40, 30, 20])  # two symbols, the words beyond, the end
    beyond = np.array([17, 9, 4])
    first = hmm.Model.first(counts, 3)
    first.others = 30.0 + 3 + 1
    gamma = rng.random((3, 3))
    later = hmm.Model.of_counts(rng.random((2, 3)), rng.random((3, 3)), np.array([[5, 6, 7], [1, 2, 3], [0, 0, 0], [1, 1, 1]]), gamma.sum(0), 7)
    for m in (first, later):
        local = m.with_words(beyond, gamma)
        assert local.emit.shape == (8, 3) and np.allclose(local.emit[:-1].sum(0), 1) and (local.emit[-1] == 1).all()


def test_rounds_end_with_the_gain(spark):
    df = spark.createDataFrame([(i, "same words in each text") for i in range(40)], "doc_id long, text string")
    head, _ = hmm.head_of(hmm.vocabulary(df))
    _, likelihoods = hmm.train(hmm.code(df, head), np.array([40.0] * 5 + [0, 40]), 2, 50)
    assert 1 < len(likelihoods) < 50 and likelihoods[-1] - likelihoods[-2] < hmm.GAIN * abs(likelihoods[-1])


def twice(spark):
    """Two chunks, which share all words."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 40_000, 400)) for i in range(100)]
    docs = [(7 * i + k, t) for k in (0, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(spark.sparkContext.parallelize(docs, 2), "doc_id long, text string"), len({w for t in texts for w in t.split()})


def test_a_round_writes_few_bytes_for_each_word_of_a_chunk(spark, monkeypatch):
    written, write = [], hmm.materialize

    def weighed(df):
        out = write(df)
        written.append(sum(f.stat().st_size for f in Path(out._closura_path.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(hmm, "materialize", weighed)
    df, words = twice(spark)
    hmm.score(df, rounds=3, symbols=2).collect()
    assert len(written) == 6 and max(written[3:]) < 20 * 2 * words  # eight states' counts; 40 bytes and more as floats with hashes


def test_emissions_sum_to_one_after_counts_moved_as_whole_numbers(spark):
    df, words = twice(spark)
    vocab = hmm.vocabulary(df)
    head, _ = hmm.head_of(vocab, symbols=2)
    plain = hmm.code(df, head)
    buckets = hmm.buckets_for(plain)
    assert buckets > 1
    coded = hmm.counted(plain, vocab, buckets)
    counts = np.append(np.sort(head.count[head.rank < 2])[::-1], [0.0, 200])
    counts[2] = 2 * 100 * 400 - counts[:2].sum()
    held = {r[0]: r[1] for r in df.select("doc_id", hmm.held_out(df["doc_id"])).collect()}
    assert any(held.values())
    model, likelihoods, replies = hmm.fit(coded, counts, 3, 4, words + 1, buckets, 0.0)
    assert likelihoods[-1] > likelihoods[0]
    rows = hmm.gathered(coded, replies).collect()
    assert len(rows) == 2
    for row in rows:
        symbols = hmm.unpacked(row["symbols"], sum(row["sizes"]))
        bucket, place, found, local = hmm.local_model(model, row.asDict(), symbols, buckets)
        assert len(bucket) == words - 2 and found.max() >= 2
        assert len(set(zip(bucket[bucket < buckets].tolist(), place[bucket < buckets].tolist()))) == (bucket < buckets).sum() > 0
        assert np.allclose(local.emit[:-1].sum(0), 1, rtol=1e-9)
