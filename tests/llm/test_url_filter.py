import random
import itertools
import math
import re

import pytest

from closura.llm import url_filter as uf
from closura.llm.queries import QUERIES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lowered, re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(urls, segmenter):
    """urls: (id, url); naive Bayes as in a book."""
    rows = [(i, *parts(u)) for i, u in urls]
    seen, n = {uf.ALLOW: {}, uf.BLOCK: {}}, {uf.ALLOW: 0, uf.BLOCK: 0}
    tokens = lambda h, p: segmenter.tokens(h) + segmenter.tokens(p)
    for _, h, p in rows:
        if verdict := rule(h, p)[1]:
            n[verdict] += 1
            for t in tokens(h, p):
                seen[verdict][t] = seen[verdict].get(t, 0) + 1
    kinds = len(seen[uf.ALLOW].keys() | seen[uf.BLOCK].keys())
    out = []
    for i, h, p in rows:
        name, verdict = rule(h, p)
        if not verdict:
            if n[uf.ALLOW] and n[uf.BLOCK]:
                total = {v: math.log(n[v]) + sum(math.log((seen[v].get(t, 0) + 1) / (sum(seen[v].values()) + kinds + 1)) for t in tokens(h, p)) for v in n}
                verdict = uf.BLOCK if total[uf.BLOCK] > total[uf.ALLOW] + 1e-9 else uf.ALLOW
            else:
                verdict = uf.BLOCK if n[uf.BLOCK] else uf.ALLOW
        out.append((str(i), h, p, str(name), verdict))
    return sorted(out)


def rows(df):
    return sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in df.collect())


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    segmenter = uf.Segmenter(dict(uf.word_counts(pages).collect()))
    assert rows(QUERIES["op4_url_filter"](spark, sf)) == brute(pages.select("page_id", "url").collect(), segmenter)


ODD = [
    None, "", "no scheme", "http://", "HTTP://A.COM/x", "https://WWW.Example.com/en/1?q#f", "x://example.com/en", "https://b.example.com/en/", "ftp://u@com/", "http://notcom/",
    "http://a.net/es/", "http://net/fr/x", "http://a.net/ES/", "http://É.NET/es/", "http://a.org\n/es/\nx", "a://b://c.com/", "http://a.org?/es/", "http://x.org/" + "long" * 5000,
]


def test_odd_rows(spark):
    data = [(i, u, f"<p>cheap pills {i}</p>") for i, u in enumerate(ODD)] + [(None, ODD[4], None), (4, ODD[4], "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], "page_id long, url string, html string, host string, n int")
    want = brute([r[:2] for r in data], uf.Segmenter(dict(uf.word_counts(df).collect())))
    assert rows(uf.judge(df)) == want
    assert rows(uf.judge(df.limit(0))) == []
    none = df.where("url IS NULL OR url LIKE '%org%'")
    assert {r["verdict"] for r in uf.judge(none).collect()} == {uf.ALLOW}


@pytest.mark.parametrize("name", ["cheappills", "pillscheap", "xq", "thecheapthe", "aaaa"])
def test_viterbi_finds_the_least_cost(name):
    segmenter = uf.Segmenter({"cheap": 5, "pills": 4, "the": 50, "a": 3, "aa": 2, "he": 9})
    cost = lambda w: segmenter.cost.get(w, segmenter.unknown + segmenter.per_letter * len(w))
    splits = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
        splits.append([name[a:b] for a, b in zip(at, at[1:])])
    got = segmenter.split(name)
    assert "".join(got) == name and sum(map(cost, got)) == pytest.approx(min(sum(map(cost, s)) for s in splits))


def test_runs_get_their_own_words_of_any_number(spark):
    """Split with the counts handed to each run as by one that knows all counts."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 90) for _ in range(400)}
    counts = spark.createDataFrame(list(words.items()), "w string, c long")
    runs = {"".join(rng.choice("abcde") for _ in range(rng.randrange(1, 40))) for _ in range(60)} | {"x" * 30, "0"}
    whole = uf.Segmenter(words)
    got = dict(uf.split_runs(spark.createDataFrame([(r,) for r in runs], "run string"), counts).collect())
    assert got == {r: ["0"] if r == "0" else whole.split(r) for r in runs}
    long = "abcd" * 50_000
    assert "".join(uf.split_runs(spark.createDataFrame([(long,)], "run string"), counts).first()["tokens"]) == long
