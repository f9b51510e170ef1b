import random

import pytest

from closura.llm import minhash
from closura.llm.queries import QUERIES


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    """docs: (doc_id, text); (doc_id, n_shingles, component_id, kept) of rows with an id"""
    sets = [sets_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, set()).add(i)
    for i, s in enumerate(sets):
        if docs[i][0] is None:
            continue
        for j in set().union(*(holders[x] for x in s)) if s else ():
            if j < i and docs[j][0] is not None and 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(docs):
        component = None if doc is None else least[find(i)]
        out.append((str(doc), len(sets[i]), str(component), component == doc))
    return sorted(out)


def rows(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op7_minhash_near_dedup"](spark, sf)) == brute(docs)


def test_chains_hubs_and_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    for _ in range(6):
        text = [word() for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(12):  # a chain of edits: ends are unlike, neighbours alike or at the border
            docs.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = word()
    docs += [None, "", " \n", "One two", "ONE two", "one two three", "x " * 100_000, "x " * 99_999]
    data = [(i, t) for i, t in enumerate(docs)]
    rng.shuffle(data)
    data += [data[0], (None, data[1][1]), (5000, data[2][1])]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in data], "doc_id long, text string, n_shingles int, key string").repartition(4)
    assert rows(minhash.judge(df)) == brute(data)
    kept = minhash.dedup(df)
    assert kept.columns == df.columns and kept.count() == sum(r[3] or r[0] == "None" for r in brute(data))
    assert minhash.judge(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(40, 100), rng.randrange(40, 100)) for _ in range(40)]
    root = list(range(101))
    for _ in range(101):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1]}


def test_minima_and_maxima_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    x, y = base[:3500], base[500:]
    values = [[(s[:, None] * minhash._TIMES + minhash._PLUS).min(0), (s[:, None] * minhash._TIMES + minhash._PLUS).max(0)] for s in (x, y)]
    same = np.mean(np.array(values[0]) == np.array(values[1]))
    assert abs(same - 0.75) < 0.1
