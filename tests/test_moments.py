import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from closura.models import log_contrast as lc
from closura.models import moments
from closura.models.estimators import fit_model
from closura.operators.metrics import regression_metrics
from closura.plans import search as se

RNG = np.random.default_rng(7)
N, P = 240, 9
X = RNG.normal(size=(N, P)) * np.linspace(0.3, 4, P) + np.arange(P)
X[:, 5] = 2.5  # one column says nothing
Y = X @ np.linspace(-1, 1, P) + RNG.normal(size=N) * 0.5


def design(spark):
    """Three fits; fit 2 has two columns less, as selections may."""
    rows = [
        (f, "val" if i % 3 == f else "train", [float(v) for v in x[: P - 2 * (f == 2)]], float(y)) for i, (x, y) in enumerate(zip(X, Y)) for f in range(3)
    ]
    return spark.createDataFrame(rows, "fit int, split string, x array<double>, y double").repartition(5)


@pytest.mark.parametrize("block", [100, 4, 3])
def test_gram_matches_numpy_in_blocks(spark, block):
    z = np.column_stack([np.ones(N), X, Y])
    rows = spark.createDataFrame([([float(v) for v in x], float(y)) for x, y in zip(X, Y)], "x array<double>, y double").repartition(4)
    got = np.full((P + 2, P + 2), np.nan)
    for r in moments.gram(rows, block=block).collect():
        at = r["i"] * block + r["r"]
        got[at, r["j"] * block : r["j"] * block + len(r["sums"])] = r["sums"]
    upper = np.triu_indices(P + 2)
    assert np.allclose(got[upper], (z.T @ z)[upper])


def test_empty_designs_are_refused(spark):
    with pytest.raises(ValueError, match="no rows"):
        moments.gram(spark.createDataFrame([], "x array<double>, y double"))


TRIALS = [("a", 0.01, 0.5), ("b", 1.0, 0.0), ("e", 50.0, 1.0)]


def test_trials_from_sums_equal_single_fits(spark):
    df = design(spark)
    got = moments.linear_trials(df, TRIALS).collect()
    weights = {(r["trial"], r["fit"]): r["w"] for r in got if r["metric"] == "weights"}
    scores = {(r["trial"], r["fit"], r["metric"]): r["value"] for r in got if r["metric"] != "weights"}
    assert len(weights) == 9 and len(scores) == 9 * 6
    for trial, alpha, l1 in TRIALS:
        for fit in range(3):
            rows = df.where(F.col("fit") == fit)
            ready = rows.select("split", array_to_vector("x").alias("features"), F.col("y").alias("label"))
            single = fit_model("linreg", ready.where("split = 'train'"), {"alpha": alpha, "l1_ratio": l1})
            scored = single.score(ready)
            x = np.array(rows.select("x").toPandas()["x"].tolist())
            w = weights[trial, fit]
            pred = np.sort(w[0] + x @ w[1:])
            assert np.allclose(pred, np.sort(scored.select("prediction").toPandas()["prediction"]), atol=1e-5)
            table = regression_metrics(scored.select(F.lit("m").alias("model"), "split", "label", F.col("prediction").alias("pred")))
            for r in table.collect():
                for m in ("rmse", "r2", "pearson"):
                    value = scores[trial, fit, f"{m}_{r['split']}"]
                    assert (value is None) == (r[m] is None) if alpha == 50.0 and m == "pearson" else value == pytest.approx(r[m], abs=1e-5)


def test_elastic_net_meets_its_conditions():
    z = (X[:, :5] - X[:, :5].mean(0)) / X[:, :5].std(0)
    c, b = z.T @ z / N, z.T @ (Y - Y.mean()) / N
    for alpha, l1 in ((0.2, 0.7), (1.0, 1.0), (0.05, 0.2)):
        w = moments.elastic_net(c, b, alpha, l1)
        g = b - c @ w - alpha * (1 - l1) * w
        on = w != 0
        assert np.allclose(g[on], alpha * l1 * np.sign(w[on]), atol=1e-9) and (np.abs(g[~on]) <= alpha * l1 + 1e-9).all()


def test_a_search_reads_its_design_once_for_any_number_of_linear_trials(spark, monkeypatch):
    from closura import bindings as b
    from closura.plans.candidates import candidates

    calls = []
    monkeypatch.setattr(se, "_fit_fold", lambda *a: calls.append(a))
    real = moments.gram
    monkeypatch.setattr(moments, "gram", lambda *a: calls.append("gram") or real(*a))
    ds = b.basket_dataset(spark, "/root/testdata/sf0.001")
    n, bounds = se.data_bounds(ds)
    fixed = {"selection": ("choice", ["abundance_topi"]), "i": ("choice", [6]), "transform": ("choice", ["clr"]), "enrich": ("choice", [None])}
    table = candidates("linreg", spark.range(8).select(F.col("id").cast("string").alias("trial")), 5, n, bounds, fixed)
    got = se.evaluate_candidates(ds, table, "acctbal", 2, seed=3)
    assert calls == ["gram"]
    assert got.where("metric = 'rmse_val'").count() == 16 and got.where("metric = 'nb_features'").count() == 16


# --- log contrast -------------------------------------------------------------------------


def contrast(spark, x, y, parts=4):
    return spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(parts)


@pytest.mark.parametrize("lam", [0.5, 0.05])
def test_log_contrast_is_the_same_by_sums_and_by_passes(spark, lam):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    y = x @ [2.0, -2, 0, 0, 1, -1] + 0.1 * rng.normal(size=80) + 3
    leaves = [1.0, 1, 1, 2, 1, 3]
    df = contrast(spark, x, y)
    by_sums = lc.fit_log_contrast(df, leaves, lam).meta
    by_passes = lc.fit_log_contrast(df, leaves, lam, block=7).meta  # one column too many for a block; the support fits
    no_block = lc.fit_log_contrast(df, leaves, lam, block=3).meta  # nor does the support
    for other in (by_passes, no_block):
        assert np.allclose(other["norefit"], by_sums["norefit"], atol=1e-6)
        assert np.allclose(other["coef"], by_sums["coef"], atol=1e-5) and other["intercept"] == pytest.approx(by_sums["intercept"], abs=1e-5)
    b = (x - x.mean(0)).T @ (y - y.mean())
    w = 1 / np.array(leaves)
    t = lam * 2 * np.max(np.abs(b) / w) * w
    for m in (by_sums, by_passes):
        assert lc.optimality(np.array(m["norefit"]), np.array(m["gradient"]), t).max() < 1e-5
        assert abs(sum(m["coef"])) < 1e-8


def test_log_contrast_takes_ten_thousand_columns(spark):
    """Far more columns than a block: no matrix of the width squared is built anywhere."""
    rng = np.random.default_rng(2)
    p = 10_000
    x = rng.normal(size=(60, p))
    y = 3 * x[:, 10] - 3 * x[:, 20] + 0.01 * rng.normal(size=60)
    m = lc.fit_log_contrast(contrast(spark, x, y), [1.0] * p, 0.5).meta
    coef = np.array(m["coef"])
    assert set(np.flatnonzero(np.abs(coef) > 0.5)) == {10, 20} and abs(coef.sum()) < 1e-6
    b = (x - x.mean(0)).T @ (y - y.mean())
    t = np.full(p, 0.5 * 2 * np.max(np.abs(b)))
    assert lc.optimality(np.array(m["norefit"]), np.array(m["gradient"]), t).max() < 1e-4
