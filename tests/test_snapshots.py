import pytest

from closura.operators import snapshot as snap
from closura.operators.prepare import prepare_features
from closura.plans.split_tables import split_train_test
from helpers import cells, column


def meta(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, host string, time int, cov string")


ONE_HOST = [("s2", "h", 2, "a"), ("s3", "h", 3, "b"), ("s5", "h", 5, "c"), ("s8", "h", 8, "d")]
FT = {"0": [6, 7, 2, 1], "1": [4, 3, 8, 9], "2": [0, 0, 0, 0]}


def one_host(spark):
    return meta(spark, ONE_HOST), prepare_features(cells(spark, FT, ["s2", "s3", "s5", "s8"], keep_zeros=True))


def test_nan_mode_keeps_every_t0(spark):
    ds = snap.snapshot_windows(*one_host(spark), "host", "time", 1, "nan")
    past = {r["sample_id"]: (r["time"], r["cov"], r["host"], r["present"]) for r in ds.samples.where("t_off = 1").collect()}
    assert past == {"s2": (1, None, "h", False), "s3": (2, "a", "h", True), "s5": (4, None, "h", False), "s8": (7, None, "h", False)}
    assert {r[0] for r in ds.features.collect()} == {"F0", "F1"}
    assert {r["sample_id"]: r["value"] for r in ds.abund.where("t_off = 1 and feature_id = 'F0'").collect()} == {"s3": 0.6}
    assert {r[0] for r in snap.missing_rows(ds, 1).collect()} == {"s2", "s5", "s8"}


def test_exclude_mode(spark):
    ds = snap.snapshot_windows(*one_host(spark), "host", "time", 1, "exclude")
    assert [r["sample_id"] for r in ds.samples.where("t_off = 0").collect()] == ["s3"]
    md = meta(spark, [("a", "h1", 1, "x"), ("b", "h1", 4, "x"), ("c", "h2", 3, "x")])
    with pytest.raises(ValueError, match="whole window"):
        snap.snapshot_windows(md, cells(spark, {"F0": [1, 1, 1]}, ["a", "b", "c"]), "host", "time", 2, "exclude")


def test_argument_checks(spark):
    md, ft = one_host(spark)
    for bad in ({"missing_mode": "other"}, {"n_prev": -1}):
        with pytest.raises(ValueError):
            snap.window_links(md, "host", "time", **{"n_prev": 1, **bad})
    text = md.withColumn("time", md["cov"])
    with pytest.raises(Exception, match="Non-numeric time"):
        snap.window_links(text, "host", "time", 1).collect()


def test_duplicates_keep_the_last_by_order(spark):
    md = spark.createDataFrame([("a", "h", 1.9, 5), ("b", "h", 1.2, 7), ("c", "h", 2.0, 1)], "sample_id string, host string, time double, o int")
    by_id = snap.last_per_time(md, "host", "time")
    assert {(r["time"], r["sample_id"]) for r in by_id.collect()} == {(1, "b"), (2, "c")}
    by_order = snap.last_per_time(md.withColumn("o", -md["o"]), "host", "time", "o")
    assert {(r["time"], r["sample_id"]) for r in by_order.collect()} == {(1, "a"), (2, "c")}


def test_wide_view(spark):
    md = spark.createDataFrame([("x", "h1", 2, 0), ("y", "h1", 3, 1), ("z", "h2", 5, 0)], "sample_id string, host_id string, time int, covariate int")
    ft = cells(spark, {"F0": [0.6, 0.7, 0.2], "F1": [0.4, 0.3, 0.8]}, ["x", "y", "z"])
    w = snap.to_wide(snap.snapshot_windows(md, ft, "host_id", "time", 1, "nan"))
    assert column(w, "F0") == {"x": 0.6, "y": 0.7, "z": 0.2}
    assert column(w, "F0__t-1") == {"x": None, "y": 0.6, "z": None}
    assert column(w, "time__t-1") == {"x": 1, "y": 2, "z": 4}
    assert column(w, "host_id__t-1") == {"x": "h1", "y": "h1", "z": "h2"}
    assert column(w, "covariate__t-1") == {"x": None, "y": 0, "z": None}


def test_merge_checks_ids_and_features(spark):
    md = meta(spark, ONE_HOST[:2])
    ft = cells(spark, {"F0": [1, 1]}, ["s2", "s3"])
    ds = snap.merge_snapshots([(md, ft), (md, ft)], [ft, ft])
    assert ds.n_prev == 1 and ds.abund.count() == 4
    with pytest.raises(ValueError, match="sample ids"):
        snap.merge_snapshots([(md, ft), (md.where("sample_id = 's2'"), ft)])
    other = cells(spark, {"F9": [1, 1]}, ["s2", "s3"])
    with pytest.raises(ValueError, match="features"):
        snap.merge_snapshots([(md, ft), (md, other)], [ft, other])


def test_labels_and_snapshot(spark):
    ds = snap.snapshot_windows(*one_host(spark), "host", "time", 1, "nan")
    assert [r["label"] for r in snap.time_labels(ds.abund).collect()] == ["t0", "t-1"]
    assert {r["t_off"] for r in snap.snapshot(ds, 1).samples.collect()} == {1}


def test_forty_of_fifty_windows_survive(spark):
    rows = [(f"{h}_{t}", f"h{h}", t, "x") for h in range(10) for t in range(5)]
    md = meta(spark, rows)
    ft = cells(spark, {"0": [1 + i % 3 for i in range(50)], "1": [2] * 50}, [r[0] for r in rows])
    ds, marks = split_train_test(md, ft, 0.8, 1, group="host", host="host", time="time", n_prev=1)
    assert ds.samples.where("t_off = 0").count() == 40
    got = marks.join(ds.samples.where("t_off = 0"), "sample_id").groupBy("host").pivot("split", ["train", "test"]).count().collect()
    assert sum(1 for r in got if r["train"]) == 8 and all(not (r["train"] and r["test"]) for r in got)
    with pytest.raises(ValueError, match="together"):
        split_train_test(md, ft, 0.8, 1, host="host")
