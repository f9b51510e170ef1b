import numpy as np
import pytest

from closura.llm import sharding
from closura.llm.queries import QUERIES, SHARDS


def brute_fill(shards, slots):
    orders = []
    for name in shards:
        start, stride = sharding.preference(name, slots)
        orders.append([(start + i * stride) % slots for i in range(slots)])
    owner, turn = {}, 0
    while len(owner) < slots:
        shard = turn % len(shards)
        owner[next(s for s in orders[shard] if s not in owner)] = shard
        turn += 1
    return [owner[s] for s in range(slots)]


def test_fill_equals_brute_force():
    assert sharding.fill(list("abcde"), 101).tolist() == brute_fill(list("abcde"), 101)
    assert sharding.fill(["only"], 7).tolist() == [0] * 7


def test_even_and_stable():
    before = sharding.fill(SHARDS)
    counts = np.bincount(before)
    assert counts.max() - counts.min() <= 1
    after = sharding.fill(SHARDS[:-1])
    kept = before != len(SHARDS) - 1
    assert (after[kept] != before[kept]).mean() < 0.05


@pytest.mark.parametrize(("shards", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 3), (["a"], 1_000_033)])
def test_refused(shards, slots):
    with pytest.raises(ValueError, match="slots|shards"):
        sharding.fill(shards, slots)


def test_query_places_every_row(spark, sf):
    got = QUERIES["op5_sharding"](spark, sf).collect()
    owner = sharding.fill(SHARDS)
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["shard"] == SHARDS[owner[r["slot"]]] for r in got)
    assert len({r["shard"] for r in got}) > 50


def test_odd_rows_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", "mine"), (1, "x", "mine"), (None, None, "mine")], "doc_id long, text string, shard string")
    placed = sharding.place(docs, ["a", "b"], slots=11)
    rows = placed.collect()
    assert placed.columns == ["doc_id", "text", "slot", "shard"] and len(rows) == 3
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1 and all(r["shard"] in "ab" for r in rows)
    sharding.write(placed, str(tmp_path / "out"), 2)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select("doc_id").toPandas()["doc_id"])) == sorted(["1.0", "1.0", "nan"])
    assert sharding.place(docs.limit(0), ["a", "b"], slots=11).collect() == []
