import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from closura.dataset import Dataset
from closura.operators import prepare as prep
from closura.operators import select as sel
from closura.operators import stats
from closura.operators.ordered import exact_quantiles, hash_rank, ordered_prefix
from helpers import cells, wide

ABUN = {"F1": [1, 2, 5], "F2": [2, 5, 0], "F3": [9, 9, 9], "F4": [10, 10, 10]}


def test_prefix_zero_removal_and_closure(spark):
    raw = cells(spark, {"0": [100, 10, 3, 5], "1": [20, 30, 0, 0], "2": [0, 0, 0, 0]}, keep_zeros=True)
    out = wide(prep.prepare_features(raw))
    assert set(out) == {"F0", "F1"}
    assert [round(out["F0"][s], 4) for s in ("s1", "s2", "s3", "s4")] == [0.8333, 0.25, 1.0, 1.0]
    assert round(out["F1"]["s1"], 4) == 0.1667 and out["F1"]["s2"] == 0.75
    assert {r[0] for r in prep.zero_features(prep.prefix_features(raw)).collect()} == {"F2"}


def test_prefix_is_always_added(spark):
    assert set(wide(prep.prefix_features(cells(spark, {"F1": [1.0]})))) == {"FF1"}


def test_alignment_precedes_zero_removal(spark):
    md = spark.createDataFrame([("s1", 1), ("s2", 2)], "sample_id string, x int")
    ft = cells(spark, {"0": [1, 2, 0], "1": [3, 4, 0], "2": [0, 0, 7]})
    ds = prep.build_dataset(md, ft)
    assert {r[0] for r in ds.features.collect()} == {"F0", "F1"}


def test_closure_is_all_or_nothing_and_rejects_empty_samples(spark):
    one_off = cells(spark, {"0": [0.5, 2.0], "1": [0.5, 2.0]})
    assert wide(prep.closed(one_off))["0"] == {"s1": 0.5, "s2": 0.5}
    proportions = cells(spark, {"0": [0.4, 0.3], "1": [0.6, 0.7]})
    assert prep.closed(proportions) is proportions
    empty = cells(spark, {"0": [0.0, 2.0], "1": [0.0, 2.0]}, keep_zeros=True)
    with pytest.raises(Exception, match="sample without counts"):
        prep.to_relative(empty).collect()
    assert {r[0] for r in prep.to_relative(empty, "drop").select("sample_id").collect()} == {"s2"}


@pytest.mark.parametrize(
    "method,params,expected",
    [("abundance_topi", {"i": i}, e) for i, e in ((1, "F1 F2 F3"), (2, "F1 F2"), (3, "F2"), (4, ""))]
    + [("variance_topi", {"i": i}, e) for i, e in ((1, "F1 F3 F4"), (2, "F3 F4"), (3, "F4"), (4, ""))]
    + [("abundance_ith", {"i": i}, e) for i, e in ((1, "F1 F2"), (2, "F1 F2"), (3, "F2"), (4, "F2"))]
    + [("variance_ith", {"i": i}, e) for i, e in ((1, "F1 F3 F4"), (2, "F1 F3 F4"), (3, "F3 F4"), (4, "F3 F4"))]
    + [("abundance_quantile", {"q": 0.5}, "F1 F2"), ("abundance_quantile", {"q": 0.9}, "F1 F2 F3")]
    + [("variance_quantile", {"q": 0.5}, "F3 F4"), ("variance_quantile", {"q": 0.9}, "F1 F3 F4")]
    + [("abundance_threshold", {"t": 10}, "F1 F2"), ("abundance_threshold", {"t": 30}, "F1 F2 F3")]
    + [("variance_threshold", {"t": 3}, "F3 F4"), ("variance_threshold", {"t": 5}, "F1 F3 F4")],
)
def test_low_features(spark, method, params, expected):
    got = sel.low_features(cells(spark, ABUN), method, 3, **params)
    assert {r[0] for r in got.collect()} == set(expected.split())


def test_fit_selection_leaves_table_when_too_little_to_group(spark):
    a = cells(spark, ABUN)
    for method, p in (("abundance_ith", {"i": 4}), ("abundance_threshold", {"t": 0.5})):
        with pytest.warns(UserWarning, match="unchanged"):
            frozen = sel.fit_selection(a, method, 3, **p)
        assert [r["feature_id"] for r in frozen.orderBy("pos").collect()] == ["F1", "F2", "F3", "F4"]
    with pytest.warns(UserWarning, match="exceeds"):
        sel.fit_selection(a, "abundance_topi", 3, i=1000)
    with pytest.raises(ValueError, match="Unknown method"):
        sel.fit_selection(a, "abundance_best", 3)


def test_apply_selection_groups_known_low_and_unseen(spark):
    frozen = sel.fit_selection(cells(spark, ABUN), "abundance_topi", 3, i=2)
    assert [r["feature_id"] for r in frozen.orderBy("pos").collect()] == ["F3", "F4", "F_low_abun"]
    new = cells(spark, {"F1": [1.0], "F3": [2.0], "F9": [5.0]})
    assert wide(sel.apply_selection(new, frozen)) == {"F3": {"s1": 2.0}, "F_low_abun": {"s1": 6.0}}
    ungrouped = sel.fit_selection(cells(spark, ABUN), None, 3)
    assert set(wide(sel.apply_selection(new, ungrouped))) == {"F1", "F3"}


def test_alr_denominator(spark):
    a = cells(spark, {"F1": [0.1, 0.2, 0.7], "F2": [0, 0, 0], "F3": [0.9, 0.8, 0.3]}, keep_zeros=True)
    order = spark.createDataFrame([("F1", 0), ("F2", 1), ("F3", 2)], "feature_id string, pos int")
    assert stats.alr_denominator(a, order).first()["pos"] == 0
    with pytest.raises(Exception, match="denominator"):
        stats.alr_denominator(a.where("feature_id = 'F2'"), order).collect()


def test_variance_with_implicit_zeros_matches_pandas(spark):
    rng = np.random.default_rng(1)
    m = rng.random((40, 7)) * (rng.random((40, 7)) < 0.4) + 1e6 * (np.arange(7) == 3)
    got = wide(stats.feature_variance(cells(spark, {f"F{j}": m[:, j] for j in range(7)}), 40).withColumn("sample_id", F.lit("v")), "variance")
    want = pd.DataFrame(m).var()
    for j in range(7):
        assert got[f"F{j}"]["v"] == pytest.approx(want[j], rel=1e-9)


def test_threshold_bounds_replaces_zero(spark):
    b = stats.threshold_bounds(cells(spark, ABUN), "variance", 3).first()
    assert b["lo"] == 1e-9 and b["hi"] == pytest.approx(np.var([2, 5, 0], ddof=1))


def test_ordered_prefix_with_a_hot_key(spark):
    rng = np.random.default_rng(0)
    key = np.where(rng.random(3000) < 0.6, "hot", rng.integers(0, 5, 3000).astype(str))
    pdf = pd.DataFrame({"k": key, "v": rng.integers(0, 20, 3000).astype(float), "id": np.arange(3000)})
    out = ordered_prefix(spark.createDataFrame(pdf).repartition(6), ["k"], [F.col("v"), F.col("id")], value="v").toPandas()
    pdf = pdf.sort_values(["k", "v", "id"])
    pdf["rank"] = pdf.groupby("k").cumcount() + 1
    pdf["cum"] = pdf.groupby("k")["v"].cumsum()
    out = out.sort_values(["k", "v", "id"])
    assert (out["rank"].to_numpy() == pdf["rank"].to_numpy()).all()
    assert np.allclose(out["cum"], pdf["cum"])
    assert out.groupby("k")["n"].first().to_dict() == pdf.groupby("k").size().to_dict()


def test_exact_quantiles_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500).astype(str), "v": rng.random(500), "id": np.arange(500)})
    out = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", "id", {"a": 0.0, "b": 0.37, "c": 1.0}).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.0, 0.37, 1.0]).unstack()
    assert np.allclose(out.sort_index()[["a", "b", "c"]], want)


def test_hash_rank_is_a_permutation(spark):
    out = hash_rank(spark.range(5000).withColumn("k", F.col("id") % 2), ["k"], "id", 1).toPandas()
    for _, g in out.groupby("k"):
        assert sorted(g["rank"]) == list(range(1, 2501))


def test_category_universe_and_labels(spark):
    md = spark.createDataFrame([("s1", "b"), ("s2", "a"), ("s3", None)], "sample_id string, c string")
    idx = stats.label_index(md, "c")
    assert [(r["label"], r["idx"]) for r in idx.orderBy("idx").collect()] == [("a", 0), ("b", 1)]
    enc = stats.encode_labels(md, "c", idx)
    assert {r["sample_id"]: r["y"] for r in enc.collect()} == {"s1": 1.0, "s2": 0.0, "s3": None}
    assert {r["sample_id"]: r["pred_label"] for r in stats.decode_labels(enc, idx, "y").collect()}["s1"] == "b"


def test_static_dataset(spark):
    ds = Dataset.static(spark.createDataFrame([("s1",)], "sample_id string"), cells(spark, {"F1": [1.0]}))
    assert ds.offsets == [0] and ds.abund.first()["t_off"] == 0
