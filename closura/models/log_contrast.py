"""Zero-sum sparse regression on node means.

min |y - c - Xa|^2 + lam * sum w|a| with sum(a) = 0, then least squares on the columns in use. A design
of one block of columns is summed up once and solved from its sums in a task; a wider one from the sums of the columns in
use, to which a pass over the rows adds those that break the minimum's conditions; if more than a block are in use, by accelerated
proximal steps, whose gradients are one pass each with the partial vectors added in two levels. All minimise the same function; vectors of the design's width are all that the driver holds.

A constant added to all cells of a row changes nothing, because the coefficients add up to zero: rows may be sparse (pos, value, y),
with the cells that are not the constant, less the constant.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.models.estimators import Fitted
from closura.models.moments import BLOCK, block_width, by_group, column_means, gradient, gram, gram_of, is_sparse, sparse_cells
from closura.session import materialize, release

# Fixed value: coefficients below this are outside the support.
SUPPORT_TOL = 1e-5
STEPS, TOLERANCE = 5000, 1e-10  # of the proximal steps over a wide design
POWER_STEPS = 30
ADMIT = 1e-8  # of the largest penalty: by how much a column outside must break the conditions to come in

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def solve_zero_sum(m: np.ndarray, b: np.ndarray, support: np.ndarray, constraint: np.ndarray) -> np.ndarray:
    """Least squares from its normal equations ``m``, ``b`` on ``support`` with constraint'beta = 0."""
    beta = np.zeros(len(b))
    s = np.flatnonzero(support)
    if len(s) == 0:
        return beta
    c = constraint[s][None, :]
    if not np.any(c):
        beta[s] = np.linalg.lstsq(m[np.ix_(s, s)], b[s], rcond=None)[0]
        return beta
    kkt = np.block([[m[np.ix_(s, s)], c.T], [c, np.zeros((1, 1))]])
    beta[s] = np.linalg.lstsq(kkt, np.append(b[s], 0.0), rcond=None)[0][: len(s)]
    return beta


def _shrink(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - t, 0.0)


def zero_sum_prox(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """argmin 0.5 |a - v|^2 + sum t |a| subject to sum(a) = 0: a one-dimensional root."""
    lo, hi = float(np.min(v - t)), float(np.max(v + t))
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if _shrink(v - mid, t).sum() > 0:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-16 * max(1.0, abs(mid)):
            break
    a = _shrink(v - 0.5 * (lo + hi), t)
    on = a != 0
    if on.any():
        a[on] -= a.sum() / on.sum()
    return a


def l1_zero_sum(g: np.ndarray, b: np.ndarray, lam: float, w: np.ndarray, iters: int = 20000, tol: float = 1e-12) -> np.ndarray:
    """min a'Ga - 2b'a + lam * sum w|a| subject to sum(a) = 0, by accelerated proximal steps
    with restarts. ``g`` and ``b`` are centred."""
    step = 1.0 / max(2.0 * float(np.linalg.eigvalsh(g)[-1]), 1e-300)
    a = np.zeros(len(b))
    y, k = a.copy(), 1.0
    for _ in range(iters):
        nxt = zero_sum_prox(y - step * 2.0 * (g @ y - b), step * lam * w)
        if np.dot(y - nxt, nxt - a) > 0:
            y, k = a.copy(), 1.0
            nxt = zero_sum_prox(y - step * 2.0 * (g @ y - b), step * lam * w)
        k2 = 0.5 * (1 + np.sqrt(1 + 4 * k * k))
        y = nxt + (k - 1) / k2 * (nxt - a)
        done = np.max(np.abs(nxt - a)) <= tol * max(1.0, float(np.max(np.abs(nxt))))
        a, k = nxt, k2
        if done:
            break
    return a


def _solved(full: np.ndarray, w: np.ndarray, lam: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Intercept and coefficients after the refit, the penalised ones, and their gradient, from the sums of (1, x, y)."""
    n, p = full[0, 0], len(full) - 2
    x, y = slice(1, p + 1), p + 1
    mean_x, mean_y = full[0, x] / n, full[0, y] / n
    g = full[x, x] - n * np.outer(mean_x, mean_x)
    b = full[x, y] - n * mean_x * mean_y
    a = l1_zero_sum(g, b, lam * 2.0 * float(np.max(np.abs(b) / w)), w)
    intercept = mean_y - mean_x @ a
    support = np.concatenate([[abs(intercept) > SUPPORT_TOL], np.abs(a) > SUPPORT_TOL])
    beta = solve_zero_sum(full[: p + 1, : p + 1], full[: p + 1, y], support, np.concatenate([[0.0], np.ones(p)]))
    return float(beta[0]), beta[1:], a, 2.0 * (g @ a - b)


def optimality(a: np.ndarray, grad: np.ndarray, t: np.ndarray) -> np.ndarray:
    """By how much each coefficient breaks the conditions of the constrained minimum, relative to the penalties
    ``t``: some one number m must have grad + m = -t * sign(a) where a is not 0, and |grad + m| <= t elsewhere."""
    on = a != 0
    scale = float(np.max(t))
    if on.any():
        m = float(np.median(-t[on] * np.sign(a[on]) - grad[on]))
        return np.where(on, np.abs(grad + m + t * np.sign(a)), np.maximum(np.abs(grad + m) - t, 0.0)) / scale
    low, high = float(np.max(-t - grad)), float(np.min(t - grad))
    return np.full(len(a), max(low - high, 0.0) / scale)


def _sums_of(rows: DataFrame, used: np.ndarray, block: int) -> DataFrame:
    """The sums of products of some columns."""
    if is_sparse(rows):
        return gram_of(rows, used)
    return gram(rows.select(F.transform(F.lit([int(i) for i in used]), lambda i: F.get("x", i)).alias("x"), "y"), block=block)


def _refit_wide(rows: DataFrame, support: np.ndarray, free: bool, n: float, mean_x: np.ndarray, mean_y: float, block: int) -> tuple[float, np.ndarray]:
    """Least squares on the columns in use with coefficients that add up to zero."""
    p = len(support)
    used = np.flatnonzero(support)
    if len(used) + 2 <= block:

        def solve(full: np.ndarray, _key) -> pd.DataFrame:
            s = np.concatenate([[free], np.ones(len(full) - 2, bool)])
            return pd.DataFrame({"beta": [solve_zero_sum(full[:-1, :-1], full[:-1, -1], s, np.concatenate([[0.0], np.ones(len(full) - 2)]))]})

        beta = np.array(by_group(_sums_of(rows, used, block), [], solve, "beta array<double>").first()["beta"]) if len(used) else np.array([mean_y if free else 0.0])
        out = np.zeros(p)
        out[used] = beta[1:]
        return float(beta[0]), out
    # conjugate gradients among vectors on the support that add up to zero
    centre = lambda v: np.where(support, v - v[used].mean(), 0.0)
    at = lambda v: mean_y - mean_x @ v if free else 0.0
    beta = np.zeros(p)
    start = gradient(rows, at(beta), beta)[2]
    r = -centre(start)
    d, size = r.copy(), float(r @ r)
    first = size
    for _ in range(len(used)):
        if size <= 1e-20 * max(first, 1e-300):
            break
        h = centre(gradient(rows, at(d), d)[2] - start)
        step = size / float(d @ h)
        beta, r = beta + step * d, r - step * h
        size, old = float(r @ r), size
        d = r + size / old * d
    return float(at(beta)), beta


def _few(rows: DataFrame, used: np.ndarray, t: np.ndarray, block: int) -> np.ndarray:
    """The minimum over the columns in ``used`` alone, from their sums, in a task."""
    own = t[used]

    def solve(full: np.ndarray, _key) -> pd.DataFrame:
        n, mx, my = full[0, 0], full[0, 1:-1] / full[0, 0], full[0, -1] / full[0, 0]
        g, b = full[1:-1, 1:-1] - n * np.outer(mx, mx), full[1:-1, -1] - n * mx * my
        return pd.DataFrame({"a": [l1_zero_sum(g, b, 1.0, own)]})

    return np.array(by_group(_sums_of(rows, used, block), [], solve, "a array<double>").first()["a"])


def _by_columns_in_use(rows: DataFrame, half, b: np.ndarray, t: np.ndarray, block: int) -> tuple[np.ndarray, bool]:
    """Coefficients, and whether they are the minimum over all columns: solved over a few columns, then joined by those
    that the gradient over all rows says break its conditions, until none does or they no longer fit a block."""
    a, grad, used = np.zeros(len(b)), -2.0 * b, np.array([], int)
    while True:
        on = a != 0
        m = float(np.median(-t[on] * np.sign(a[on]) - grad[on])) if on.any() else (float(np.max(-t - grad)) + float(np.min(t - grad))) / 2
        off = np.abs(grad + m) - t
        off[used] = 0.0
        worst = np.argsort(-off)[: max(2, block // 4)]
        worst = worst[off[worst] > ADMIT * float(np.max(t))]
        if not len(worst):
            return a, True
        if len(used) + len(worst) + 2 > block:
            return a, False
        used = np.sort(np.concatenate([used, worst]))
        a = np.zeros(len(b))
        a[used] = _few(rows, used, t, block)
        grad = 2.0 * half(a)


def _fit_wide(rows: DataFrame, w: np.ndarray, lam: float, block: int, steps: int = STEPS, tol: float = TOLERANCE) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """As ``_solved``, by passes over the rows."""
    cells = ["pos", "value"] if is_sparse(rows) else ["x"]
    rows = materialize(rows.select(*cells, F.col("y").cast("double").alias("y")))
    mean_y, n = rows.agg(F.avg("y"), F.count(F.lit(1)).cast("double")).first()
    p = len(w)
    mean_x = column_means(rows, p)
    # the gradient of half the squared error, with the best intercept for a
    half = lambda a: gradient(rows, float(mean_y - mean_x @ a), a)[2]
    b = -half(np.zeros(p))
    t = lam * 2.0 * float(np.max(np.abs(b) / w)) * w
    a, whole = _by_columns_in_use(rows, half, b, t, block)
    if not whole:
        a = _by_steps(half, b, t, a, steps, tol)
    grad = 2.0 * half(a)
    intercept = mean_y - mean_x @ a
    beta0, beta = _refit_wide(rows, np.abs(a) > SUPPORT_TOL, abs(intercept) > SUPPORT_TOL, n, mean_x, mean_y, block)
    release(rows)
    return beta0, beta, a, grad


def _by_steps(half, b: np.ndarray, t: np.ndarray, a: np.ndarray, steps: int, tol: float) -> np.ndarray:
    """Accelerated proximal steps from ``a``, one pass each."""
    v = b / max(float(np.linalg.norm(b)), 1e-300)
    top = 0.0
    for _ in range(POWER_STEPS):
        gv = half(v) + b
        size = float(np.linalg.norm(gv))
        if size == 0:
            break
        done = abs(size - top) <= 1e-3 * size
        top, v = size, gv / size
        if done:
            break
    step = 1.0 / max(2.2 * top, 1e-300)
    y, k = a.copy(), 1.0
    for _ in range(steps):
        nxt = zero_sum_prox(y - step * 2.0 * half(y), step * t)
        restart = float(np.dot(y - nxt, nxt - a)) > 0
        moved = float(np.max(np.abs(nxt - a), initial=0.0))
        k2 = 1.0 if restart else 0.5 * (1 + np.sqrt(1 + 4 * k * k))
        y = nxt if restart else nxt + (k - 1) / k2 * (nxt - a)
        a, k = nxt, k2
        if moved <= tol * max(1.0, float(np.max(np.abs(a), initial=0.0))):
            break
    return a


def fit_log_contrast(rows: DataFrame, n_leaves: list[float], lam: float, block: int = BLOCK) -> Fitted:
    """``rows``: x (node means), y; or sparse. ``lam`` is relative to the smallest penalty that zeroes everything."""
    w = 1.0 / np.asarray(n_leaves, dtype=float)
    p = len(w) if is_sparse(rows) else block_width(rows)
    if p + 2 <= block:
        sums = gram_of(rows, np.arange(p)) if is_sparse(rows) else gram(rows, block=block)

        def solve(full: np.ndarray, _key) -> pd.DataFrame:
            intercept, beta, a, grad = _solved(full, w, lam)
            return pd.DataFrame({"intercept": [intercept], "beta": [beta], "a": [a], "grad": [grad]})

        row = by_group(sums, [], solve, "intercept double, beta array<double>, a array<double>, grad array<double>").first()
        intercept, beta, a, grad = row["intercept"], np.array(row["beta"]), np.array(row["a"]), np.array(row["grad"])
    else:
        intercept, beta, a, grad = _fit_wide(rows, w, lam, block)
    return Fitted(
        "log_contrast", {},
        {"intercept": float(intercept), "coef": beta.tolist(), "norefit": a.tolist(), "gradient": grad.tolist(), "width": p, "n_classes": None},
    )


def predict_sparse(fitted: Fitted, rows: DataFrame, fill: float) -> DataFrame:
    """``rows`` (pos, value and more) with ``pred`` in place of the cells; ``fill`` is the constant of the other cells."""
    coef = np.array(fitted.meta["coef"])
    start = float(fitted.meta["intercept"]) + fill * float(coef.sum())
    kept = [c for c in rows.columns if c not in ("pos", "value")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, value = sparse_cells(batch)
            pred = start + np.bincount(at, value * coef[pos], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(pred, pa.float64())], [*kept, "pred"])

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], "pred double"])
    return rows.mapInArrow(work, schema)
