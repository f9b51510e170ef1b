import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from closura.operators import checks
from closura.operators import metrics as m
from closura.operators import trials as t


def preds(spark, rows, cols="label double, pred double"):
    return spark.createDataFrame([(f"s{i}", "m", *r) for i, r in enumerate(rows)], "sample_id string, model string, split string, " + cols)


def test_regression_golden(spark):
    p = preds(spark, [("train", a, a + 0.1) for a in (7.0, 8.0, 9.0)] + [("test", a, a + 0.1) for a in (14.0, 15.0)])
    got = {r["split"]: r for r in m.with_p_value(m.regression_metrics(p)).collect()}
    assert got["train"]["rmse"] == pytest.approx(0.1) and got["train"]["r2"] == pytest.approx(0.985)
    assert got["test"]["r2"] == pytest.approx(0.96) and got["test"]["pearson"] == pytest.approx(1.0)
    assert got["train"]["pearson_pvalue"] == pytest.approx(0, abs=1e-7) and got["test"]["pearson_pvalue"] == 1.0


def test_p_values_against_known_t_quantiles():
    # two-sided t quantiles at 5 %: 2.228 (10 df), 2.042 (30 df)
    for df, q in ((10, 2.2281388519649385), (30, 2.0422724563012373)):
        r = q / np.sqrt(df + q * q)
        assert m.pearson_p(r, df + 2) == pytest.approx(0.05, abs=1e-9)
    assert m.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-12)


def test_perfect_train_and_absent_class(spark):
    rows = [("train", c, c, [float(c == k) for k in "abc"]) for c in "abc"] + [("test", "a", "a", [0.9, 0.1, 0.0]), ("test", "b", "a", [0.6, 0.3, 0.1])]
    p = preds(spark, rows, "label string, pred string, proba array<double>")
    got = {r["split"]: r for r in m.classification_metrics(p, list("abc")).collect()}
    tr, te = got["train"], got["test"]
    assert tr["f1_macro"] == tr["balanced_accuracy"] == tr["mcc"] == tr["roc_auc_macro_ovr"] == 1.0
    assert te["roc_auc_macro_ovr"] is None
    assert te["f1_macro"] == pytest.approx((2 / 3 + 0) / 2) and te["balanced_accuracy"] == 0.5
    assert te["log_loss"] == pytest.approx(-(np.log(0.9) + np.log(0.3)) / 2)
    assert tr["log_loss"] == pytest.approx(0, abs=1e-12)


def test_auc_equals_pairwise_count(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    p = preds(spark, [("train", str(a), str(a), [float(1 - b), float(b)]) for a, b in zip(y, s)], "label string, pred string, proba array<double>")
    d = s[y == 1][:, None] - s[y == 0][None, :]
    assert m.roc_auc(p, ["0", "1"]).first()["roc_auc_macro_ovr"] == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())


def folds(spark, values, metric="rmse_val", trial="t"):
    return spark.createDataFrame([(trial, metric, i, v) for i, v in enumerate(values)], "trial string, metric string, fold int, value double")


def test_fold_statistics(spark):
    r = t.aggregate_folds(folds(spark, [0.4, 0.5, 0.6])).first()
    assert (r["mean"], r["std"], r["se"], r["n_folds"]) == (pytest.approx(0.5), pytest.approx(0.1), pytest.approx(0.1 / np.sqrt(3)), 3)
    r = t.aggregate_folds(folds(spark, [0.4, float("nan"), float("nan")])).first()
    assert r["mean"] == 0.4 and r["std"] is None and r["se"] is None and r["n_folds"] == 3
    assert t.aggregate_folds(folds(spark, [float("nan")] * 2)).count() == 0
    run = {r["fold"]: r for r in t.running_folds(folds(spark, [0.4, 0.5, 0.6]), 3).collect()}
    assert set(run) == {0, 1} and run[0]["se"] is None and run[1]["mean"] == pytest.approx(0.45)


def trials(spark, rows):
    return spark.createDataFrame(rows, "trial string, rmse_val_mean double, rmse_val_se double, nb_features double, alpha double")


def test_one_se_prefers_the_simplest_in_the_band(spark):
    pick = lambda rows, mode="min": t.select_one_se(trials(spark, rows), "rmse_val", mode, "linreg").first()["trial"]
    rows = [("a", 0.45, 0.05, 200.0, 1.0), ("b", 0.47, 0.05, 180.0, 1.0), ("c", 0.49, 0.05, 60.0, 1.0)]
    assert pick(rows) == "c"
    assert pick([("a", 0.45, 0.001, 200.0, 1.0), *rows[1:]]) == "a"
    assert pick([("a", 0.85, 0.04, 200.0, 1.0), ("b", 0.82, 0.04, 50.0, 1.0)], "max") == "b"
    nan = float("nan")
    assert pick([*rows, ("z", 0.1, nan, 1.0, 1.0)]) == "c"
    assert pick([("a", 0.5, nan, 1.0, 1.0), ("b", 0.4, None, 9.0, 1.0)]) == "b"
    # equal width: the larger penalty is simpler; a missing setting comes last
    assert pick([("a", 0.45, 0.05, 5.0, 0.1), ("b", 0.45, 0.05, 5.0, 9.0), ("c", 0.45, 0.05, 5.0, None)]) == "b"


def test_failure_policy(spark):
    def frame(n, bad):
        return spark.createDataFrame([(str(i), "OOM" if i < bad else None) for i in range(n)], "trial string, error_class string")

    assert t.check_failures(frame(10, 0), 0.1)["num_errors"] == 0
    with pytest.warns(RuntimeWarning):
        assert t.check_failures(frame(10, 1), 0.1)["error_classes"] == ["OOM"]
    with pytest.raises(RuntimeError, match="exceeds"):
        t.check_failures(frame(10, 2), 0.1)
    with pytest.raises(RuntimeError, match="0 trials"):
        t.check_failures(frame(0, 0), 0.1)


def test_best_iteration(spark):
    rows = [("a", 0, 10), ("a", 1, 21), ("a", 2, 30), ("b", 0, 10), ("b", 1, None), ("b", 2, 30), ("c", 0, 10), ("c", 1, 11)]
    df = spark.createDataFrame(rows, "trial string, fold int, best_iter int")
    assert {r[0]: r[1] for r in t.best_iteration(df.where("trial <> 'c'"), 3, 77).collect()} == {"a": 22, "b": 77}
    assert t.best_iteration(df.where("trial = 'c'"), 2, 77).first()["n_estimators"] == 11


@pytest.mark.parametrize("w", [5, 20, 1])
def test_rolling_mean_matches_pandas_across_runs(spark, monkeypatch, w):
    monkeypatch.setattr(t, "ROLLING_CHUNK", 25)
    rng = np.random.default_rng(w)
    pdf = pd.DataFrame({"id": np.arange(203), "ts": rng.permutation(203), "y": rng.random(203)})
    pdf.loc[7, "y"] = np.nan
    got = t.rolling_mean(spark.createDataFrame(pdf), "y", "ts", w, "id").toPandas().sort_values("ts")["smoothed"]
    want = pdf.sort_values("ts")["y"].rolling(w, center=True, min_periods=1).mean()
    assert np.allclose(got.astype(float), want, equal_nan=True)


def test_trial_tables(spark):
    runs = spark.createDataFrame([("r1", "e1", "FINISHED", 1700000000123, None, {"a": "1"}, {"rmse": 0.5}, {"m": "x"}), ("r2", "e9", "FAILED", 0, 5, {"b": "2"}, {}, {})],
        "run_id string, experiment_id string, status string, start_ms long, end_ms long, params map<string,string>, metrics map<string,double>, tags map<string,string>")
    exps = spark.createDataFrame([("e1", "first")], "experiment_id string, experiment_name string")
    log = {r["run_id"]: r.asDict() for r in t.trial_log(runs, exps).collect()}
    assert log["r1"]["experiment_name"] == "first" and log["r2"]["experiment_name"] == ""
    assert log["r1"]["params.a"] == "1" and log["r2"]["params.a"] is None and log["r1"]["metrics.rmse"] == 0.5
    assert log["r1"]["end_time"] is None
    same = spark.createDataFrame([("r1", 1, "k", None), ("r2", 1, "k", 3)], "run_id string, a int, b string, c int")
    assert t.varying_columns(same).columns == ["run_id"]
    axes = spark.createDataFrame([("r1", 1.0, "z"), ("r2", None, "a"), ("r3", 2.0, "b")], "run_id string, v double, k string")
    assert {r["run_id"]: r["k_code"] for r in t.trial_axes(axes, ["v", "k"]).collect()} == {"r1": 1, "r3": 0}


def test_gates(spark):
    md = spark.createDataFrame([("s1", 1.0, None), ("s2", float("nan"), "b")], "sample_id string, n double, c string")
    with pytest.raises(ValueError, match="missing values"):
        checks.check_enrich_nulls(md, ["n"], ["linreg", "rf"])
    checks.check_enrich_nulls(md, ["n"], ["rf", "gbt"])
    checks.check_enrich_nulls(md, ["c"], ["linreg"])
    levels = spark.createDataFrame([(0.5,), (1.5,), (2.4,), (2.5,)], "y double")
    assert checks.check_ordinal_levels(levels, "y", 2) == 2  # half-even: 0, 2, 2, 2
    three = levels.union(spark.createDataFrame([(9.0,)], "y double"))
    with pytest.raises(ValueError, match="exceed the cap"):
        checks.check_ordinal_levels(three, "y", 2)
    for cap in (1, 2.0, True):
        with pytest.raises(ValueError, match="integer"):
            checks.check_ordinal_levels(levels, "y", cap)


def test_top_features(spark):
    df = spark.createDataFrame([("c", "a", -3.0), ("c", "b", 1.0), ("d", "a", 0.5), ("d", "b", 2.0)], "class string, feature string, v double")
    got = {(r["class"], r["feature"]) for r in m.top_features(df, "v", 1).collect()}
    assert got == {("c", "a"), ("d", "b")}
