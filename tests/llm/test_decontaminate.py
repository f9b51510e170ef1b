import hashlib
import re

import pytest

from closura.llm import decontaminate as dc
from closura.llm.queries import QUERIES


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, span=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + span]), set()).add("null" if item is None else str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (of := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= of
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def rows(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


@pytest.mark.parametrize("few", [500_000, 0])
def test_query_equals_brute_force(spark, sf, few, monkeypatch):
    monkeypatch.setattr(dc.checked, "__defaults__", (few,))  # 0: nothing is broadcast
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
    want = brute(docs, items)
    assert rows(QUERIES["op1_decontamination"](spark, sf)) == want
    assert any(r[5] for r in want)


A = " ".join(f"alpha{i}" for i in range(20))
ITEMS = [(1, A), (2, A), (3, "Short É item"), (4, None), (5, " .. "), (None, "lonely"), (7, "b b b b b b b b b b b b b b b"), (7, "b b b b b b b b b b b b b b b")]
DOCS = [
    (1, None), (2, ""), (3, A), (3, A), (3, "other"), (None, A[7:]), (4, "x " + A.replace(" ", "-.-").upper() + " y"), (5, "short é ITEM, Short É item"),
    (6, "lonely " * 30_000), (7, "b " * 40), (8, A[:60]), (9, " ".join(f"alpha{i}" for i in range(12)) + " q " + " ".join(f"alpha{i}" for i in range(12, 20))),
    (10, "w " * 1000 + A), (11, "short item é"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in DOCS], "doc_id long, text string, n_words int, key string")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, term string")
    want = brute(DOCS, ITEMS)
    assert rows(dc.report(docs, items)) == want
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    bad = [r for r in want if r[5]]
    assert kept.count() == len(DOCS) - len(bad)
    assert rows(dc.report(docs.limit(0), items)) == []
    assert rows(dc.report(docs, items.limit(0))) == brute(DOCS, [])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "a b c"), (3, "c x x x x x x a b"), (4, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, w) for w in "abc"], "item long, word string").select("item", dc.term("word").alias("term"))
    index = dc.build_index(docs)
    ids = {r["key"]: r["doc_id"] for r in index.where("doc_id is not null").collect()}
    found = lambda slop: sorted((ids[r["key"]], r["pos"]) for r in dc.proximity_matches(index, asked, slop).collect())
    assert found(2) == [(2, 2)]  # c is rarest
    assert found(5) == [(1, 5), (2, 2)]
    assert found(8) == [(1, 5), (2, 2), (3, 0)]
    assert index.count() == 6 + 3 + 9 + 2 + 4
