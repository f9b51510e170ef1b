import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from closura.models import explain as ex
from closura.models import tree_shap
from closura.models.estimators import fit_model, to_features

RNG = np.random.default_rng(9)
X = RNG.normal(size=(90, 4))
X[::9, 2] = np.nan
Y = np.nan_to_num(X[:, 2]) * X[:, 0] + 2 * (X[:, 1] > 0) + RNG.normal(size=90) * 0.1
CLS = np.digitize(Y, np.quantile(Y, [0.4, 0.8])).astype(float)


def frame(spark, y=Y):
    rows = [(f"s{i:03d}", [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, "sample_id string, x array<double>, y double").repartition(4)


def exact(outputs, x, background):
    """By all subsets: outputs(rows) -> [row, class]."""
    p = len(x)
    values = {}
    for s in itertools.product((False, True), repeat=p):
        values[s] = outputs(np.where(np.array(s), x, background)).mean(axis=0)
    phi = np.zeros((p, len(values[s])))
    for s, v in values.items():
        for j in range(p):
            if not s[j]:
                t = tuple(a or i == j for i, a in enumerate(s))
                phi[j] += math.factorial(sum(s)) * math.factorial(p - sum(s) - 1) / math.factorial(p) * (values[t] - v)
    return phi


@pytest.mark.parametrize("kind,params,k", [
    ("rf", {"n_estimators": 4, "max_depth": 4}, None), ("rf_class", {"n_estimators": 3, "max_depth": 3}, 3),
    ("gbt", {"n_estimators": 5, "max_depth": 3}, None), ("gbt_class", {"n_estimators": 2, "max_depth": 2}, 3)])
def test_values_equal_all_subsets_and_add_up(spark, monkeypatch, kind, params, k):
    monkeypatch.setattr(tree_shap, "PART", 7)  # many parts
    monkeypatch.setattr(tree_shap, "GROUP", 2)
    monkeypatch.setattr(tree_shap, "SAMPLES", 3)
    df = frame(spark, Y if k is None else CLS)
    train = df.select(to_features(F.col("x"), kind).alias("features"), F.col("y").alias("label"))
    fitted = fit_model(kind, train, params, n_classes=k, seed=3)
    trees = tree_shap.trees_of(spark, fitted)

    def outputs(rows):
        rows = np.where(np.isnan(rows), -1e300, rows)
        total = np.zeros((len(rows), k or 1))
        for t in trees:
            for i, row in enumerate(rows):
                node = 0
                while t["column"][node] >= 0:
                    node = t["left"][node] if row[t["column"][node]] <= t["bound"][node] else t["right"][node]
                total[i] += t["value"][node]
        return total

    scored = fitted.score(train).toPandas()
    if kind in ("rf", "gbt"):  # the trees read back say what the model says
        start = fitted.meta["boosted"]["start"][0] if kind == "gbt" else 0.0
        assert np.allclose(np.sort(outputs(X)[:, 0] + start), np.sort(scored["prediction"]))
    elif kind == "rf_class":
        assert np.allclose(np.sort(outputs(X)[:, 1]), np.sort(np.stack(scored["proba"])[:, 1]))
    some = [0, 5, 9, 44]
    classes = ["u", "v", "w"][: k or 1]
    got = tree_shap.tree_shapley(fitted, df.where(F.col("sample_id").isin([f"s{i:03d}" for i in some])), df, list("abcd"), classes).collect()
    assert len(got) == len(some) * 4 * len(classes)
    mean = outputs(X).mean(axis=0)
    for i in some:
        want = exact(outputs, X[i], X)
        mine = np.zeros((4, len(classes)))
        for r in got:
            if r["sample_id"] == f"s{i:03d}":
                mine["abcd".index(r["feature"]), classes.index(r["class"])] = r["phi"]
        assert np.allclose(mine, want, atol=1e-9)
        assert np.allclose(mine.sum(axis=0), outputs(X[i : i + 1])[0] - mean)


def test_sampled_values_come_close(spark):
    df = frame(spark).where("not exists(x, v -> isnan(v))")
    fitted = fit_model("rf", df.select(array_to_vector("x").alias("features"), F.col("y").alias("label")), {"n_estimators": 5, "max_depth": 3}, seed=1)
    rows = df.where("sample_id < 's004'")
    a = tree_shap.tree_shapley(fitted, rows, df, list("abcd"), ["y"]).toPandas().sort_values(["sample_id", "feature"])
    b = ex.shapley_sample(fitted, rows, df, list("abcd"), ["y"], n_perm=640).toPandas().sort_values(["sample_id", "feature"])
    assert np.abs(a["phi"].to_numpy() - b["phi"].to_numpy()).max() < 0.1


def test_other_models_and_empty_backgrounds_are_refused(spark):
    df = frame(spark)
    fitted = fit_model("gbt", df.select(to_features(F.col("x"), "gbt").alias("features"), F.col("y").alias("label")), {"n_estimators": 1, "max_depth": 1})
    with pytest.raises(ValueError, match="empty background"):
        tree_shap.tree_shapley(fitted, df, df.limit(0), list("abcd"), ["y"])
    with pytest.raises(ValueError, match="outputs"):
        tree_shap.tree_shapley(fitted, df, df, list("abcd"), ["y", "z", "u"])
    with pytest.raises(TypeError):
        tree_shap.trees_of(spark, ex.Fitted("linreg", {}, {}))
