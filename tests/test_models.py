import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from closura.models import explain as ex
from closura.models import log_contrast as lc
from closura.models.estimators import Fitted, first_unbeaten, fit_model, to_features
from closura.operators import tree as tr
from closura.operators.prepare import build_dataset
from closura.plans import search as se
from closura.plans.candidates import candidates, with_start_points
from helpers import cells

RNG = np.random.default_rng(2)
X = RNG.normal(size=(80, 4)) * [1, 3, 0.5, 2] + [0, 1, 2, 3]
Y = X @ [1.0, -0.5, 0.0, 2.0] + RNG.normal(size=80) * 0.3
CLS = (X[:, 0] + X[:, 3] > 3).astype(float)


def frame(spark, x=X, y=Y):
    rows = [(f"s{i:03d}", [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id string, x array<double>, y double")


def train(df):
    return df.select("sample_id", array_to_vector("x").alias("features"), F.col("y").alias("label"))


def coordinate_descent(z, y, alpha, l1, iters=4000):
    n, w, r = len(y), np.zeros(z.shape[1]), y - y.mean()
    for _ in range(iters):
        for j in range(z.shape[1]):
            r = r + z[:, j] * w[j]
            c = z[:, j] @ r / n
            w[j] = np.sign(c) * max(abs(c) - alpha * l1, 0) / (z[:, j] @ z[:, j] / n + alpha * (1 - l1))
            r = r - z[:, j] * w[j]
    return w


@pytest.mark.parametrize("alpha,l1", [(0.1, 0.5), (1.0, 0.0), (0.5, 1.0)])
def test_linreg_is_the_standardised_elastic_net(spark, alpha, l1):
    fitted = fit_model("linreg", train(frame(spark)), {"alpha": alpha, "l1_ratio": l1})
    z = (X - X.mean(0)) / X.std(0)
    assert np.allclose(fitted.stages["main"].stages[-1].coefficients.toArray(), coordinate_descent(z, Y, alpha, l1), atol=1e-6)


def test_logreg_l2_has_a_zero_gradient(spark):
    fitted = fit_model("logreg", train(frame(spark, y=CLS)), {"C": 0.7, "penalty": "l2"}, n_classes=2)
    m = fitted.stages["main"].stages[-1]
    w, b = m.coefficients.toArray(), m.intercept
    z = (X - X.mean(0)) / X.std(0)
    p = 1 / (1 + np.exp(-(z @ w + b)))
    assert np.abs(0.7 * z.T @ (p - CLS) + w).max() < 1e-4 and abs((p - CLS).sum()) < 1e-4


@pytest.mark.parametrize("kind,params,k", [
    ("rf", {"n_estimators": 10, "max_depth": None}, None), ("gbt", {"n_estimators": 10, "max_depth": 3}, None),
    ("rf_class", {"n_estimators": 10, "max_depth": 4}, 2), ("gbt_class", {"n_estimators": 5, "max_depth": 2}, 3),
    ("mlp_class", {"n_hidden_layers": 1, "width": 8}, 2), ("ordinal", {"C": 10.0}, 3), ("logreg", {"C": 1.0, "penalty": "elasticnet", "l1_ratio": 0.5}, 3)])
def test_models_learn(spark, kind, params, k):
    y = Y if k is None else (np.digitize(X[:, 0] + X[:, 3], np.quantile(X[:, 0] + X[:, 3], np.arange(1, k) / k)).astype(float))
    df = train(frame(spark, y=y)).cache()
    out = fit_model(kind, df, params, n_classes=k, seed=1).score(df).toPandas()
    if k is None:
        assert np.corrcoef(out["prediction"], out["label"])[0, 1] > 0.9
    else:
        assert (out["prediction"] == out["label"]).mean() > 0.75
        assert np.allclose(np.stack(out["proba"]).sum(axis=1), 1) and np.stack(out["proba"]).shape[1] == k


def test_trees_accept_missing_values(spark):
    x = X.copy()
    x[::7, 1] = np.nan
    df = frame(spark, x=x).select(to_features(F.col("x"), "rf").alias("features"), F.col("y").alias("label"))
    assert fit_model("rf", df, {"n_estimators": 5, "max_depth": 3}).score(df).count() == 80


def test_early_stop_rule():
    assert first_unbeaten([3, 2, 1, 2, 2, 2], 3) == 2
    assert first_unbeaten([3, 2, 1, 2, 0.5], 3) is None
    assert first_unbeaten([], 3) is None


def test_least_squares_on_a_support():
    a = np.array([[1.0, 0, 0, 1], [0, 1, 0, 1], [0, 0, 1, 0]])
    y = np.array([1.0, 2, 3])
    free = lc.solve_zero_sum(a.T @ a, a.T @ y, np.ones(4, bool), np.zeros(4))
    assert np.allclose(free, np.linalg.lstsq(a, y, rcond=None)[0], atol=1e-6)
    part = lc.solve_zero_sum(a.T @ a, a.T @ y, np.array([True, True, True, False]), np.zeros(4))
    assert part[3] == 0 and np.allclose(part[:3], y, atol=1e-6)


def test_l1_zero_sum_satisfies_its_optimality_conditions():
    x = RNG.normal(size=(60, 7))
    y = x @ [2.0, -2, 0, 0, 1, -1, 0] + 0.1 * RNG.normal(size=60)
    x, y = x - x.mean(0), y - y.mean()
    g, b, w = x.T @ x, x.T @ y, np.array([1, 1, 1, 1, 0.5, 0.5, 0.25])
    lam = 0.2 * 2 * np.max(np.abs(b) / w)
    a = lc.l1_zero_sum(g, b, lam, w)
    assert abs(a.sum()) < 1e-10
    grad = 2 * (g @ a - b)
    on = np.abs(a) > 1e-9
    mu = -(grad[on] + lam * w[on] * np.sign(a[on]))  # equal multipliers on the support
    assert np.ptp(mu) < 1e-5
    assert (np.abs(grad[~on] + mu.mean()) <= lam * w[~on] + 1e-5).all()


def test_log_contrast_model(spark):
    df = frame(spark)
    fitted = lc.fit_log_contrast(df, [1.0, 1, 1, 2], 0.01)
    coef = np.array(fitted.meta["coef"])
    assert abs(coef.sum()) < 1e-9
    out = fitted.score(train(df)).toPandas()
    assert np.allclose(out.sort_values("sample_id")["prediction"], X @ coef + fitted.meta["intercept"])


def test_linear_shap_adds_up(spark):
    df = frame(spark)
    fitted = fit_model("linreg", train(df), {"alpha": 0.05, "l1_ratio": 0.2})
    w = ex.raw_weights(fitted)
    phi = ex.linear_shap(df, df, w, list("abcd"), ["y"]).groupBy("sample_id").agg(F.sum("phi").alias("s")).toPandas().set_index("sample_id")["s"]
    pred = fitted.score(train(df)).toPandas().set_index("sample_id")["prediction"]
    assert np.allclose(phi.sort_index(), (pred - pred.mean()).sort_index())


def test_sampled_shapley_is_exact_for_linear_models_and_additive(spark):
    df = frame(spark)
    fitted = fit_model("linreg", train(df), {"alpha": 0.05, "l1_ratio": 0.2})
    bg = df.where("sample_id = 's000'")
    got = ex.shapley_sample(fitted, df.where("sample_id < 's005'"), bg, list("abcd"), ["y"], n_perm=3).toPandas()
    w = ex.raw_weights(fitted)[0]
    for r in got.itertuples():
        i, j = int(r.sample_id[1:]), "abcd".index(r.feature)
        assert r.phi == pytest.approx(w[j] * (X[i, j] - X[0, j]), abs=1e-9)
    forest = fit_model("rf_class", train(frame(spark, y=CLS)), {"n_estimators": 5, "max_depth": 3}, n_classes=2)
    one = df.where("sample_id < 's003'")
    phi = ex.shapley_sample(forest, one, bg, list("abcd"), ["n", "p"], n_perm=2).where("class = 'p'").groupBy("sample_id").agg(F.sum("phi").alias("s"))
    proba = {r["sample_id"]: r["proba"][1] for r in forest.score(train(df)).collect()}
    for r in phi.collect():
        assert r["s"] == pytest.approx(proba[r["sample_id"]] - proba["s000"])


def test_coefficient_tables(spark):
    binary = fit_model("logreg", train(frame(spark, y=CLS)), {"C": 1.0, "penalty": "l2"}, n_classes=2)
    assert ex.coefficients(spark, binary, list("abcd")).columns == ["feature", "coefficient", "abs_coefficient"]
    y3 = np.digitize(X[:, 0], [-0.4, 0.4]).astype(float)
    multi = fit_model("logreg", train(frame(spark, y=y3)), {"C": 1.0, "penalty": "l2"}, n_classes=3)
    table = ex.coefficients(spark, multi, list("abcd"), ["u", "v", "w"])
    assert table.count() == 12 and {r["class"] for r in table.collect()} == {"u", "v", "w"}
    with pytest.raises(ValueError, match="features"):
        ex.coefficients(spark, multi, ["a"])
    with pytest.raises(TypeError):
        ex.coefficients(spark, fit_model("rf", train(frame(spark)), {"n_estimators": 2, "max_depth": 2}), list("abcd"))


BOUNDS = {"abundance": (0.1, 5.0), "variance": (1e-9, 0.1)}


def test_candidate_ranges(spark):
    trials = spark.range(400).select(F.col("id").cast("string").alias("trial"))
    c = candidates("linreg", trials, 1, 12, BOUNDS, has_taxonomy=True, enrich_with=("m",)).toPandas()
    assert c["alpha"].between(1e-5, 100).all() and 0.2 < (c["alpha"] < 0.03).mean() < 0.8
    assert c["selection"].dropna().nunique() == 8 and c["selection"].isna().any()
    byi = c["selection"].str.endswith(("_ith", "_topi"), na=False)
    assert c.loc[byi, "i"].between(1, 12).all() and c.loc[~byi, "i"].isna().all()
    assert c["q"].dropna().between(0.5, 0.9).all() and c["transform"].dropna().nunique() == 5 and c["enrich"].dropna().nunique() == 3
    var = c["selection"] == "variance_threshold"
    assert c.loc[var, "t"].between(1e-9, 0.1).all() and c["aggregation"].dropna().nunique() == 4
    lr = candidates("logreg", trials, 1, 12, BOUNDS).toPandas()
    assert (lr["l1_ratio"].notna() == (lr["penalty"] == "elasticnet")).all() and lr["aggregation"].isna().all()
    assert candidates("log_contrast", trials, 1, 12, BOUNDS).toPandas()["selection"].isna().all()
    with pytest.raises(ValueError, match="unknown model type"):
        candidates("svm", trials, 1, 12, BOUNDS)
    s = with_start_points(candidates("linreg", trials, 1, 12, BOUNDS), [{"alpha": 6.5}]).toPandas().set_index("trial")
    assert s.loc["0", "alpha"] == 6.5


@pytest.fixture(scope="module")
def ds(spark):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 9, (36, 6)) + np.eye(36, 6)
    ids = [f"s{i:02d}" for i in range(36)]
    share = m / m.sum(axis=1, keepdims=True)
    rows = [(s, f"h{i % 12}", float(3 * share[i, 0] - share[i, 1]), "lo" if share[i, 0] < np.median(share[:, 0]) else "hi") for i, s in enumerate(ids)]
    md = spark.createDataFrame(rows, "sample_id string, host string, y double, c string")
    return build_dataset(md, cells(spark, {str(j): m[:, j] for j in range(6)}, ids))


SMALL = {"selection": ("choice", ["abundance_topi"]), "i": ("int", 3, 5), "transform": ("choice", ["clr"]), "enrich": ("choice", [None]), "alpha": ("float", 1e-4, 1e-2, True)}


def test_search_refit_predict_evaluate_and_reload(spark, ds, tmp_path):
    tm, fold_metrics = se.find_best(ds, "y", "linreg", 2, 2, seed=1, group="host", overrides=SMALL)
    names = {r["metric"] for r in fold_metrics.select("metric").distinct().collect()}
    assert {"rmse_val", "rmse_train", "r2_val", "nb_features"} <= names
    preds = tm.predict(ds, "y")
    assert preds.count() == 36
    scores = {(r["split"], r["metric"]): r["value"] for r in se.evaluate({"m": tm}, ds, ds, "y").collect()}
    assert scores[("test", "r2")] == scores[("train", "r2")] > 0.5
    se.save_model(tm, str(tmp_path / "m"))
    again = se.load_model(spark, str(tmp_path / "m")).predict(ds)
    a, b = (sorted((r["sample_id"], r["pred"]) for r in d.collect()) for d in (preds, again))
    assert a == b
    with pytest.raises(TypeError, match="probabilities"):
        tm.predict_proba(ds)


def test_classifier_search_and_probabilities(ds):
    tm, fold_metrics = se.find_best(ds, "c", "logreg", 1, 2, seed=1, stratify=["c"], overrides={**{k: v for k, v in SMALL.items() if k != "alpha"}, "C": ("float", 10.0, 20.0, True)})
    assert fold_metrics.where("metric = 'roc_auc_macro_ovr_val'").count() == 2
    p = tm.predict_proba(ds).toPandas()
    assert set(p["class"]) == {"hi", "lo"} and np.allclose(p.groupby("sample_id")["proba"].sum(), 1)
    assert set(tm.predict(ds).toPandas()["pred"]) <= {"hi", "lo"}


def test_failed_trials_stop_the_search(ds, spark):
    table = candidates("linreg", spark.range(1).select(F.lit("0").alias("trial")), 1, 6, BOUNDS, SMALL).withColumn("alpha", F.lit(None).cast("double"))
    with pytest.warns(UserWarning, match="failed"), pytest.raises(RuntimeError, match="exceeds"):
        se.evaluate_candidates(ds, table, "y", 2)


def test_log_contrast_through_the_tree(spark, ds, tmp_path):
    e = [(f"F{j}", "a" if j < 3 else "b", True, j) for j in range(6)] + [("a", "root", False, 10), ("b", "root", False, 11)]
    matrix = tr.tip_ancestors(spark.createDataFrame(e, "node string, parent string, is_tip boolean, ord long"))
    tree = se.Tree(matrix, tr.matrix_columns(matrix))
    tm = se.refit(ds, "y", "log_contrast", {"lambda": 0.05}, tree=tree)
    assert abs(sum(tm.fitted.meta["coef"])) < 1e-9
    table = ex.coefficients(spark, tm.fitted, tm.names)
    assert table.count() == 8
    se.save_model(tm, str(tmp_path / "lc"))
    again = se.load_model(spark, str(tmp_path / "lc"))
    a, b = (sorted((r["sample_id"], r["pred"]) for r in m.predict(ds).collect()) for m in (tm, again))
    assert a == b


def test_sampled_shapley_uses_every_background_row(spark):
    fixed = Fitted("log_contrast", {}, {"intercept": 5.0, "coef": [1.0, -2.0, 3.0], "width": 3, "n_classes": None})
    back = RNG.normal(size=(70, 3)) * [1, 10, 100]
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "sample_id string, x array<double>")
    background = spark.createDataFrame([(f"b{i}", [float(v) for v in x]) for i, x in enumerate(back)], "sample_id string, x array<double>")
    phi = {r["feature"]: r["phi"] for r in ex.shapley_sample(fixed, rows, background, list("pqr"), ["y"], n_perm=2).collect()}
    want = np.array([1.0, -2.0, 3.0]) * (np.array([1.0, 2.0, 3.0]) - back.mean(0))
    assert np.allclose([phi[f] for f in "pqr"], want)


def test_search_over_types_shares_one_metric_table_and_explains(spark, ds):
    small = {k: v for k, v in SMALL.items() if k != "i"} | {"i": ("int", 4, 4), "n_estimators": ("choice", [5]), "max_depth": ("choice", [3])}
    models, folds = se.find_best_of(ds, "y", ["linreg", "rf"], 1, 2, seed=1, overrides=small, start_points={"linreg": [{"alpha": 0.5}]})
    assert set(models) == {"linreg", "rf"}
    assert {r["trial"] for r in folds.select("trial").distinct().collect()} == {"linreg-0", "rf-0"}
    table = se.explain(models["linreg"], ds, ds)
    assert table.columns == ["feature", "coefficient", "abs_coefficient"] and table.count() == len(models["linreg"].names)
    one = ds.with_(samples=ds.samples.where("sample_id = 's00'"), abund=ds.abund.where("sample_id = 's00'"))
    phi = se.explain(models["rf"], one, ds, n_perm=1).agg(F.sum("phi")).first()[0]
    pred = {r["sample_id"]: r["pred"] for r in models["rf"].predict(ds).collect()}
    assert np.isclose(phi, pred["s00"] - np.mean(list(pred.values())))
