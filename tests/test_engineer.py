import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from closura.dataset import Dataset
from closura.operators.prepare import build_dataset
from closura.operators.snapshot import snapshot_windows
from closura.operators.splits import assign_folds
from closura.plans import engineer as eng
from closura.streaming.apply import design_row
from helpers import cells

RNG = np.random.default_rng(5)
N, P = 30, 8
M = RNG.integers(0, 20, (N, P)) * (RNG.random((N, P)) < 0.6) + np.eye(N, P)
IDS = [f"s{i:02d}" for i in range(N)]


@pytest.fixture(scope="module")
def ds(spark) -> Dataset:
    md = spark.createDataFrame([(s, f"h{i % 10}", float(i), "ab"[i % 2]) for i, s in enumerate(IDS)], "sample_id string, host string, y double, c string")
    return build_dataset(md, cells(spark, {str(j): M[:, j] for j in range(P)}, IDS))


SHARES = pd.DataFrame(M / M.sum(axis=1, keepdims=True), index=IDS, columns=[f"F{j}" for j in range(P)])


def np_select(train: pd.DataFrame, method, arg):
    v = train.sum() if method.startswith("abundance") else train.var()
    rank = pd.DataFrame({"v": v, "f": v.index}).sort_values(["v", "f"], ascending=[False, True])["f"].tolist()
    low = set(rank[arg:]) if method.endswith("topi") else set(v.index[v < v.quantile(arg)])
    return sorted(set(v.index) - low) if len(low) > 1 else sorted(v.index), low if len(low) > 1 else set()


def np_apply(frame, kept, low, group):
    out = frame[kept].copy()
    if low:
        out[group] = frame[sorted(low)].sum(axis=1)
    return out


def np_clr(frame):
    logs = np.log(frame.replace(0, 1e-9))
    return logs.sub(logs.mean(axis=1), axis=0)


def as_frame(x):
    return pd.DataFrame({r["sample_id"]: r["x"] for r in x.collect()}).T.sort_index()


@pytest.mark.parametrize("method,arg,group", [("abundance_topi", 4, "F_low_abun"), ("variance_quantile", 0.6, "F_low_var")])
def test_fit_and_apply_match_pandas(ds, method, arg, group):
    cfg = eng.Config(selection=method, i=arg if isinstance(arg, int) else None, q=arg if isinstance(arg, float) else None, transform="clr")
    x, frozen = eng.engineer(ds, cfg)
    kept, low = np_select(SHARES, method, arg)
    want = np_clr(np_apply(SHARES, kept, low, group))
    assert eng.design_names(frozen) == [f"clr_{c}" for c in want.columns]
    assert np.allclose(as_frame(x), want)


def test_folds_are_leak_free_and_match_separate_fits(ds):
    folds = assign_folds(ds.samples, 3, 1, group="host")
    fold = {r["sample_id"]: r["fold"] for r in folds.collect()}
    cfg = eng.Config(selection="variance_topi", i=3, transform="clr")
    x, frozen = eng.engineer_folds(ds, folds, 3, cfg)
    rows = x.collect()
    for fit in (0, 1, 2, -1):
        train = SHARES.loc[[s for s in IDS if fold[s] != fit]]
        kept, low = np_select(train, "variance_topi", 3)
        want = np_clr(np_apply(SHARES, kept, low, "F_low_var"))
        got = pd.DataFrame({r["sample_id"]: r["x"] for r in rows if r["fit"] == fit}).T.sort_index()
        assert np.allclose(got, want)
        assert {r["sample_id"] for r in rows if r["fit"] == fit and r["split"] == "val"} == {s for s in IDS if fold[s] == fit}
        assert eng.design_names(frozen, fit) == [f"clr_{c}" for c in want.columns]


def test_alr_denominator_is_learned_on_train_only(ds):
    folds = assign_folds(ds.samples, 3, 1)
    fold = {r["sample_id"]: r["fold"] for r in folds.collect()}
    x, frozen = eng.engineer_folds(ds, folds, 3, eng.Config(selection="abundance_topi", i=3, transform="alr"))
    rows = x.collect()
    for fit in (0, 1, 2, -1):
        train = SHARES.loc[[s for s in IDS if fold[s] != fit]]
        kept, low = np_select(train, "abundance_topi", 3)
        table = np_apply(SHARES, kept, low, "F_low_abun")
        d = int(np.argmax((np_apply(train, kept, low, "F_low_abun") != 0).sum().to_numpy()))
        filled = table.replace(0, 1e-9)
        want = filled.drop(columns=filled.columns[d]).div(filled.iloc[:, d], axis=0)
        got = pd.DataFrame({r["sample_id"]: r["x"] for r in rows if r["fit"] == fit}).T.sort_index()
        assert np.allclose(got, want, rtol=1e-9)


def test_split_fit_uses_train_statistics_and_all_categories(ds):
    splits = ds.samples.select("sample_id", F.when(F.col("c") == "a", "train").otherwise("test").alias("split"))
    cfg = eng.Config(selection="abundance_topi", i=2, enrich="metadata_only", enrich_with=("c", "y"))
    x, frozen = eng.engineer_split(ds, splits, cfg)
    kept, low = np_select(SHARES.loc[IDS[::2]], "abundance_topi", 2)
    assert eng.design_names(frozen) == [*kept, "F_low_abun", "c_b", "y"]
    got = as_frame(x)
    assert np.allclose(got.iloc[:, :3].astype(float), np_apply(SHARES, kept, low, "F_low_abun"))
    assert got.iloc[:, 3].tolist() == [float(i % 2) for i in range(N)]


def test_a_single_surviving_column_is_not_transformed(spark):
    md = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    one = build_dataset(md, cells(spark, {"0": [3.0, 4.0]}, ["a", "b"]))
    for t in ("clr", "ilr", "alr", "pa", "rank"):
        x, frozen = eng.engineer(one, eng.Config(transform=t))
        assert as_frame(x).to_numpy().tolist() == [[1.0], [1.0]] and eng.design_names(frozen) == ["F0"]


def test_missing_past_comes_back_as_nan(spark):
    md = spark.createDataFrame([("a", "h", 1, 5.0), ("b", "h", 2, 6.0), ("c", "h", 4, 7.0)], "sample_id string, host string, time int, m double")
    ft = cells(spark, {"F0": [0.6, 0.2, 0.5], "F1": [0.4, 0.8, 0.5]}, ["a", "b", "c"])
    win = snapshot_windows(md, ft, "host", "time", 1, "nan")
    x, frozen = eng.engineer(win, eng.Config(selection="variance_topi", i=2, enrich="shannon_and_metadata", enrich_with=("m",)))
    assert eng.design_names(frozen) == ["F0", "F1", "F0__t-1", "F1__t-1", "shannon_entropy", "m", "shannon_entropy__t-1", "m__t-1"]
    got = as_frame(x)
    assert np.isnan(got.loc["a"].astype(float)).tolist() == [False, False, True, True, False, False, True, True]
    assert got.loc["b"].tolist()[2:4] == [0.6, 0.4] and got.loc["b"].tolist()[7] == 5.0
    h = -(0.6 * np.log(0.6 + 1e-9) + 0.4 * np.log(0.4 + 1e-9))
    assert got.loc["b"].tolist()[6] == pytest.approx(h)


def test_config_rejects_unknown_methods():
    for bad in ({"transform": "sqrt"}, {"enrich": "weather"}):
        with pytest.raises(ValueError, match="unknown transform"):
            eng.Config(**bad)


def test_row_local_apply_equals_batch_on_a_stream(spark, ds, tmp_path):
    cfg = eng.Config(selection="abundance_topi", i=4, transform="clr", enrich="shannon")
    x, frozen = eng.engineer(ds, cfg)
    rows = ds.abund.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("feature_id", "value"))).alias("cells"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = design_row(stream, frozen).writeStream.format("memory").queryName("designs").start()
    q.processAllAvailable()
    q.stop()
    assert np.allclose(as_frame(spark.table("designs")).astype(float), as_frame(x).astype(float))
