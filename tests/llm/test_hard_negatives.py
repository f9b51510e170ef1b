import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from closura.llm import hard_negatives
from closura.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, score string, block string"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    used = [
        (i, label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, q in used:
        if a % every:
            continue
        found = sorted((-sum(x * y for x, y in zip(q, r)), i, other) for i, other, r in used if i != a)
        for p, pid, _ in [f for f in found if f[2] == label][:positives]:
            band = [(s, i) for s, i, other in found if other != label and low * -p <= 100 * -s <= high * -p]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(band[:negatives])]
    return sorted(out)


def mined(spark, rows, every=100, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % every == 0, **kw).collect())


def moved(rows):
    return [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]


def test_query_equals_brute_force(spark, sf):
    got = sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, sf).collect())
    assert got == brute(moved(spark.read.parquet(f"{sf}/embeddings.parquet").collect()))


@pytest.mark.parametrize("dealt", [False, True])
def test_blocks_ties_and_sizes(spark, monkeypatch, dealt):
    """Many small blocks, few different vectors (so ties), components of very unlike sizes."""
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "STRIPE", 1)
    if dealt:
        monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", 0)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 11) / 4 * 10.0 ** (i % 3)], int(i % 4 and 1)) for i in range(300)]
    assert mined(spark, rows, 9) == brute(rows, 9)


def test_odd_rows(spark):
    v = [0.5, -0.25, 0.125]
    rows = [
        (0, v, 1), (1, v, 1), (2, v, 2), (3, None, 1), (4, [0.5, None, 0.1], 1), (5, [float("nan"), 0.0, 0.0], 2), (6, [float("inf")], 2),
        (7, v, None), (None, v, 2), (8, [], 2), (9, [0.4, -0.2], 2), (9, [0.4, -0.2], 2), (100, [0.0, 0.0, 0.0], 3), (200, [-1e-9] * 20, 3),
    ]
    got = mined(spark, rows)
    assert got == brute(rows) and got
    assert mined(spark, rows[:1]) == []
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


def test_scores_beyond_63_bits_are_refused(spark):
    with pytest.raises(Exception, match="63 bits"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1), (2, [1.0], 2)])


def test_lookups_give_inner_products():
    rng = np.random.default_rng(5)
    for most in (3, 300, 70_000):
        a, c = (rng.integers(-most, most, (n, 24)) for n in (7, 40))
        got = hard_negatives.scores(hard_negatives.subset_sums(a), hard_negatives.bit_planes(c), 0, 40, np.int64)
        assert (got == c @ a.T).all()
