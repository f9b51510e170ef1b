import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from closura.models import boosting
from closura.models.estimators import fit_model

RNG = np.random.default_rng(11)
N = 150
X = RNG.integers(0, 12, size=(N, 4)) / 4.0
Y = np.sin(X[:, 0]) * 3 + X[:, 1] * X[:, 2] + RNG.normal(size=N) * 0.1
CLS = (Y > np.median(Y)).astype(float)
THREE = np.digitize(Y, np.quantile(Y, [0.33, 0.66])).astype(float)


def frame(spark, x=X, y=Y):
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(3)
    return df.select(array_to_vector("x").alias("features"), "label")


def soft(g, alpha):
    return np.sign(g) * max(abs(g) - alpha, 0)


def grow(x, g, h, depth, p):
    """A plain recursive tree: returns a function from a row to its leaf weight."""
    value = -soft(g.sum(), p["reg_alpha"]) / (h.sum() + p["reg_lambda"])
    best = (0, None)
    worth = lambda m: soft(g[m].sum(), p["reg_alpha"]) ** 2 / (h[m].sum() + p["reg_lambda"])
    if depth:
        for j in range(x.shape[1]):
            for c in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= c
                if min(h[left].sum(), h[~left].sum()) < p["min_child_weight"]:
                    continue
                gain = 0.5 * (worth(left) + worth(~left) - worth(np.ones(len(x), bool))) - p["gamma"]
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (j, c))
    if best[1] is None:
        return lambda row: value
    j, c = best[1]
    m = x[:, j] <= c
    left, right = grow(x[m], g[m], h[m], depth - 1, p), grow(x[~m], g[~m], h[~m], depth - 1, p)
    return lambda row: left(row) if row[j] <= c else right(row)


BASE = {"n_estimators": 3, "max_depth": 3, "eta": 0.3, "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "min_child_weight": 1.0}


def plain(x, y, p, objective, start):
    margin = np.tile(start, (len(x), 1)).astype(float)
    for _ in range(p["n_estimators"]):
        g, h, _ = boosting.gradients(objective, y, margin)
        trees = [grow(x, g[:, k], h[:, k], p["max_depth"], p) for k in range(g.shape[1])]
        margin += p["eta"] * np.array([[t(row) for t in trees] for row in x])
    return margin


@pytest.mark.parametrize("change", [{}, {"reg_alpha": 20.0}, {"reg_lambda": 40.0}, {"min_child_weight": 30.0}, {"gamma": 15.0}, {"num_parallel_tree": 3}])
def test_trees_follow_the_formulas(spark, change):
    p = {**BASE, **change}
    model = fit_model("gbt", frame(spark), p)
    got = model.score(frame(spark)).toPandas()["prediction"]
    want = plain(X, Y, p, "squared", [Y.mean()])[:, 0]
    assert np.allclose(np.sort(got), np.sort(want))
    if change and "num_parallel_tree" not in change:
        assert not np.allclose(np.sort(want), np.sort(plain(X, Y, BASE, "squared", [Y.mean()])[:, 0]))


def test_classes_grow_together(spark):
    model = fit_model("gbt_class", frame(spark, y=THREE), {**BASE, "max_depth": 2}, n_classes=3)
    assert len(model.meta["boosted"]["trees"]) == 9
    out = model.score(frame(spark, y=THREE)).toPandas()
    shares = np.log([(THREE == k).mean() for k in range(3)])
    m = plain(X, THREE, {**BASE, "max_depth": 2}, "softmax", shares)
    want = np.exp(m - m.max(1, keepdims=True))
    want /= want.sum(1, keepdims=True)
    assert np.allclose(np.sort(np.stack(out["proba"])[:, 0]), np.sort(want[:, 0]))
    assert (out["prediction"] == out["label"]).mean() > 0.8
    two = fit_model("gbt_class", frame(spark, y=CLS), {**BASE, "max_depth": 2}, n_classes=2).score(frame(spark, y=CLS)).toPandas()
    assert (two["prediction"] == two["label"]).mean() > 0.85 and np.allclose(np.stack(two["proba"]).sum(1), 1)


def test_growing_stops_by_the_validation_loss(spark, monkeypatch):
    monkeypatch.setattr(boosting, "REBASE", 4)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)  # nothing to learn
    vx, vy = rng.normal(size=(60, 3)), rng.normal(size=60)
    p = {**BASE, "n_estimators": 25, "eta": 0.5}
    passes = []
    real = boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: passes.append(1) or real(*a))
    model = fit_model("gbt", frame(spark, x, y), p, val=frame(spark, vx, vy))
    best, losses = model.meta["best_iter"], model.meta["boosted"]["losses"]
    assert best is not None and len(model.meta["boosted"]["trees"]) == best + 1 and losses[best] == min(losses[: best + 11])
    assert len(losses) == best + 11 and len(passes) <= len(losses) * 3 + 1  # one fit, ended at once
    error = ((model.score(frame(spark, vx, vy)).toPandas()["prediction"] - frame(spark, vx, vy).toPandas()["label"]) ** 2).mean()
    assert error == pytest.approx(losses[best])


def test_draws_differ_by_tree_and_share(spark):
    kept = boosting._drawn(5, np.arange(10_000), 0.3)
    assert 0.27 < kept.mean() < 0.33 and (kept != boosting._drawn(6, np.arange(10_000), 0.3)).any() and boosting._drawn(5, np.arange(9), 1.0).all()
    p = {**BASE, "n_estimators": 2, "num_parallel_tree": 2, "subsample": 0.7, "colsample": 0.5}
    a, b = (fit_model("gbt", frame(spark), p, seed=s).meta["boosted"]["trees"] for s in (1, 2))
    assert len(a) == 4 and a[0] != a[1] and a != b
    assert all(len({j for j in t["column"] if j >= 0}) <= 4 for t in a)


def test_many_values_few_rows_and_constant_columns(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=400), np.full(400, 7.0), np.where(rng.random(400) < 0.2, -1e300, rng.normal(size=400))])
    y = (x[:, 0] > 0.3) * 2.0 + (x[:, 2] < -1e200)
    out = fit_model("gbt", frame(spark, x, y), {**BASE, "n_estimators": 10}).score(frame(spark, x, y)).toPandas()
    assert ((out["prediction"] - out["label"]) ** 2).mean() < 0.1
    one = fit_model("gbt", frame(spark, x[:1], y[:1]), BASE).score(frame(spark, x[:3], y[:3])).toPandas()
    assert np.allclose(one["prediction"], y[0])
