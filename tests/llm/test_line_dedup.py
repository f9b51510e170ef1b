import random
import re

import pytest

from closura.llm import line_dedup
from closura.llm.queries import QUERIES


def words(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line.lower())


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def brute(docs):
    """docs: (doc_id, text) with distinct ids; {doc: (text, n_lines, n_dropped, n_near)}"""
    earlier, exact, out = [], set(), {}
    for doc, text in sorted(docs):
        if text is None:
            out[doc] = (None, 0, 0, 0)
            continue
        kept, near = [], 0
        lines = text.split("\n")
        for line in lines:
            w = words(line)
            key = tuple(w)
            is_near = len(w) >= 8 and any(one_edit(w, e) for e in earlier if e != w and abs(len(e) - len(w)) <= 1)
            twin_before_first = is_near if key not in exact else near_of[key]
            if len(w) >= 5:
                if key not in exact:
                    near_of[key] = is_near
                if key in exact or is_near:
                    near += twin_before_first
                    exact.add(key)
                    if len(w) >= 8:
                        earlier.append(w)
                    continue
                exact.add(key)
                if len(w) >= 8:
                    earlier.append(w)
            kept.append(line)
        out[doc] = ("\n".join(kept), len(lines), len(lines) - len(kept), near)
    near_of.clear()
    return out


near_of: dict = {}


def rows(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["n_near"]) for r in df.collect()}


def edited(rng, line):
    w = line.split()
    i = rng.randrange(len(w))
    kind = rng.randrange(4)
    w[i : i + (kind < 2)] = ["new"] if kind in (0, 2) else []
    return " ".join(w)


@pytest.mark.parametrize("few", [500_000, 0])
def test_random_edits_equal_brute_force(spark, few, monkeypatch):
    from closura.llm import decontaminate

    monkeypatch.setattr(decontaminate.checked, "__defaults__", (few,))
    rng = random.Random(few)
    base = [" ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(rng.choice([4, 5, 7, 8, 9, 12, 31]))) for _ in range(25)]
    docs = []
    for doc in range(40):
        lines = [rng.choice([lambda x: x, str.upper, lambda x: edited(rng, x), lambda x: edited(rng, edited(rng, x))])(rng.choice(base)) for _ in range(8)]
        docs.append((doc, "\n".join([*lines, "", "tiny line"])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(line_dedup.dedup(df, counts=True)) == brute(docs)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows(QUERIES["op2_line_dedup"](spark, sf))
    assert got == brute([tuple(r) for r in docs])


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    data = [
        (3, long), (1, f"start of one\n{long}"), (2, None), (4, ""), (5, "\n\n"), (6, f"{long}\nin one  document\n{long.upper()} \n"), (6, "same id, other text here"),
        (None, "comes first: one two three four"), (7, "comes first: one two three four"), (8, "x " * 50_000), (9, "x " * 50_000 + "y"), (3, long),
    ]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in data], "doc_id long, text string, key string, line int")
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    want = [
        (3, ""), (3, ""), (1, f"start of one\n{long}"), (2, None), (4, ""), (5, "\n\n"), (6, "in one  document\n"), (6, "same id, other text here"),
        (None, "comes first: one two three four"), (7, ""), (8, "x " * 50_000), (9, ""),
    ]
    assert got == sorted((str(d), str(t)) for d, t in want)
    assert line_dedup.dedup(df.limit(0)).collect() == []


def test_variant_hashes_name_their_words(spark):
    """Equal variants have equal hashes, unlike ones do not, and a line's own hash meets the variants of a longer one."""
    lines = ["a b c d e f g h", "a b c d e f g h i", "a b X d e f g h", "b c d e f g h a", "a a a a a a a a"]
    df = spark.createDataFrame([(k, t.split(), len(t.split()), k) for k, t in enumerate(lines)], "h long, words array<string>, n int, first int")
    by_hash = {}
    for r in line_dedup._variants(df).collect():
        w = lines[r["h"]].split()
        left = tuple(w if r["i"] < 0 else w[: r["i"]] + w[r["i"] + 1 :])
        assert r["m"] == len(left)
        by_hash.setdefault(r["variant"], set()).add(left)
    assert all(len(v) == 1 for v in by_hash.values()) and len(by_hash) == len({w for v in by_hash.values() for w in v})


def test_very_long_lines_cost_their_words_once(spark):
    base = [f"w{i}" for i in range(60_000)]
    edited = base[:31_000] + ["new"] + base[31_001:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(base[1:]))], "doc_id long, text string")
    got = rows(line_dedup.dedup(docs, counts=True))
    assert [got[i][1:] for i in (1, 2, 3)] == [(1, 0, 0), (1, 1, 1), (1, 1, 1)]
