import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from closura.llm import bpe, packing
from closura.llm.queries import END_OF_TEXT, QUERIES, RANKS

PATH, PATTERN = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
ODD = [None, "", " ", "\n \n", "a" * 5000, "  x \t\ty 　z", "😀🏽 é́ ​\x1c\x85", "'s 'T I'll 12a", "<|endoftext|>", "word " * 30_000]


@pytest.fixture(scope="module")
def truth():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_equal_the_rank_librarys(texts):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(PATH, PATTERN).ranks, special_tokens={})
    model = bpe.load(PATH, PATTERN)
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)
        assert model.decode_bytes(ids.tolist()).decode() == text == "".join(model.decode_stream(ids.tolist()))


def test_small_cache_changes_nothing(truth):
    model = bpe.load(PATH, PATTERN)
    recent, model.recent = model.recent, bpe.RecentMatches(3)
    try:
        texts = ["a b c d e f a b", "f e d", "a b"]
        assert [x.tolist() for x in model.encode(texts)] == [truth.encode_ordinary(t) for t in texts]
    finally:
        model.recent = recent


def test_query_and_odd_rows(spark, sf, truth):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD + ODD[-1:])] + [(None, "x", "x")], "doc_id long, text string, ids string")
    for frame, got in ((docs, QUERIES["op6_byte_bpe"](spark, sf)), (odd, bpe.round_trip(odd, PATH, PATTERN))):
        want = []
        for doc, text in frame.select("doc_id", "text").collect():
            ids = truth.encode_ordinary(text or "")
            want.append((str(doc), len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
    assert bpe.round_trip(odd.limit(0), PATH, PATTERN).collect() == []


def test_encode_decode_frames_and_offsets(spark, truth):
    rows = [(i, t) for i, t in enumerate(ODD[:-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = bpe.encode(docs, PATH, PATTERN, offsets=True)
    for r in encoded.collect():
        text = rows[r["doc_id"]][1] or ""
        assert r["ids"] == truth.encode_ordinary(text)
        data = text.encode()
        at = 0
        for token, start, end in zip(r["ids"], r["starts"], r["ends"], strict=True):
            piece = truth.decode_single_token_bytes(token)
            first, last = len(data[:at].decode(errors="ignore")), len(data[: at + len(piece)].decode(errors="replace"))
            assert (start, end) == (first, last)
            at += len(piece)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH, PATTERN).collect()}
    assert texts == {i: t or "" for i, t in rows}


def test_halves_of_a_character():
    model = bpe.load(PATH, PATTERN)
    ids = next(iter(model.encode(["🏽"]))).tolist()
    assert len(ids) > 1 and "".join(model.decode_stream(ids[:-1])) == "�"


def brute_best_fit(sizes, length):
    rows, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [r for r in range(len(rows)) if room[r] >= sizes[i]]
        if fits:
            row = min(fits, key=lambda r: room[r])
        else:
            rows.append([])
            room.append(length)
            row = len(rows) - 1
        rows[row].append(i)
        room[row] -= sizes[i]
    return room


@pytest.mark.parametrize("length", [1, 2, 7, 64])
def test_tree_finds_the_best_fit(length):
    rng = random.Random(length)
    for _ in range(60):
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(brute_best_fit(sizes, length))


def unpacked(rows, length):
    docs = {}
    for r in rows:
        ids, positions = np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["positions"], np.uint32)
        cu = r["cu_seqlens"]
        assert len(ids) == len(positions) == length and cu[0] == 0 and cu[-1] == r["n_tokens"] <= length
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            docs.setdefault(doc, {}).setdefault(start, []).append(ids[a:b].tolist())
    return docs


def test_packing_loses_nothing(spark, sf, truth):
    rows = QUERIES["op9_token_packing"](spark, sf).collect()
    got = unpacked(rows, packing.LENGTH)
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert got.keys() == texts.keys() and len({r["pack_id"] for r in rows}) == len(rows)
    for doc, text in texts.items():
        ids = [t for start in sorted(got[doc]) for t in got[doc][start][0]]
        assert ids == [*truth.encode_ordinary(text), END_OF_TEXT]
    assert sum(r["n_tokens"] for r in rows) > 0.9 * packing.LENGTH * len(rows)


def test_packing_odd_rows(spark, truth):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(1, "", 0), (None, "z", 0)], "doc_id long, text string, n_tokens int")
    got = unpacked(packing.pack(docs, PATH, PATTERN, END_OF_TEXT, 16, 1000).collect(), 16)
    assert got.keys() == {None, *range(len(ODD))} and got[1] == {0: [[END_OF_TEXT]] * 2}
    for doc, text in enumerate(ODD):
        if doc != 1:
            assert [t for s in sorted(got[doc]) for t in got[doc][s][0]] == [*truth.encode_ordinary(text or ""), END_OF_TEXT]
    assert packing.pack(docs.limit(0), PATH, PATTERN, END_OF_TEXT).collect() == []
