"""Linear models from mergeable sums.

``gram`` reduces a design to sums of products z z', z = (1, x, y), in blocks of columns: a design of one
block is summed in place, one of several is dealt by pairs of blocks, so no task holds more than a few
blocks whatever the width. Any number of penalties and folds are then solved from the sums, in tasks
(``by_group``); nothing of the width squared reaches the driver. Designs of more than one block are not
solved from their sums: ``gradient`` gives X'(Xa - y) by one pass whose partial vectors are added in two levels.

Rows are dense (x, y), or sparse: (pos, value, y) with the cells that are not zero. ``gradient`` takes both.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 2048  # columns to a block: 32 MB of sums
HELD = 4  # blocks of sums a task holds
FAN_IN = 64  # partial vectors added by a task of the first level
LAID_OUT = 4_000_000  # cells of sparse rows laid out at once: 32 MB
PAIR_SALT = 8  # tasks that share the rows of a pair of blocks


def block_width(rows: DataFrame) -> int:
    """The columns of a design; of the widest, if fits differ."""
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if width is None:
        raise ValueError("no rows")
    return width


def _sums(by: list[str]):
    """Sums of products per (by, i, j) over a partition, handed over row by row."""

    def rows_of(key: tuple, total: np.ndarray) -> pd.DataFrame:
        at = pd.DataFrame({"r": np.arange(len(total), dtype=np.int32), "sums": list(total)})
        for name, value in zip([*by, "i", "j"], key):
            at[name] = value
        return at[[*by, "i", "j", "r", "sums"]]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, some in pdf.groupby([*by, "i", "j"], sort=False):
                product = np.stack(some["a"].to_numpy()).T @ np.stack(some["b"].to_numpy())
                if key in held:
                    held[key] += product
                    continue
                if len(held) >= HELD:
                    for old in list(held):
                        yield rows_of(old, held.pop(old))
                held[key] = product
        for key, total in held.items():
            yield rows_of(key, total)

    return work


def gram(rows: DataFrame, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """by, i, j, r, sums: row ``i * block + r`` of the matrix of (1, x, y), columns from ``j * block`` on."""
    by = list(by or [])
    blocks = math.ceil((block_width(rows) + 2) / block)
    z = F.concat(F.array(F.lit(1.0)), F.col("x"), F.array(F.col("y").cast("double")))
    types = {c: rows.schema[c].dataType.simpleString() for c in by}
    df = rows.select(*by, z.alias("z"))
    if blocks == 1:
        df = df.select(*by, F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("z").alias("a"), F.col("z").alias("b"))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(blocks) for j in range(i, blocks)])
        df = df.select(*by, "z", F.explode(pairs).alias("p"))
        part = lambda k: F.slice("z", F.col(f"p.{k}") * block + 1, F.lit(block))
        df = df.select(*by, "p.i", "p.j", part("i").alias("a"), part("j").alias("b"), F.pmod(F.xxhash64("z"), F.lit(PAIR_SALT)).alias("salt"))
        df = df.repartition(*by, "i", "j", "salt").drop("salt")
    schema = ", ".join([*[f"{c} {t}" for c, t in types.items()], "i int, j int, r int, sums array<double>"])
    return _added(df.mapInPandas(_sums(by), schema), [*by, "i", "j", "r"])


def _added(partial: DataFrame, keys: list[str]) -> DataFrame:
    summed = partial.select(*keys, array_to_vector("sums").alias("v")).groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("s"))
    return summed.select(*keys, vector_to_array("s").alias("sums"))


def is_sparse(rows: DataFrame) -> bool:
    return "pos" in rows.columns


def sparse_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row within the batch, position and value of every cell."""
    pos, value = batch.column("pos"), batch.column("value")
    return np.repeat(np.arange(batch.num_rows), pos.value_lengths().to_numpy()), pos.flatten().to_numpy(), value.flatten().to_numpy()


def gram_of(rows: DataFrame, columns: np.ndarray) -> DataFrame:
    """``gram`` of some columns (in order, one block at most) of sparse rows; a task lays out a few rows at a time."""
    width = len(columns) + 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        step = max(1, LAID_OUT // width)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                at, pos, value = sparse_cells(batch)
                place = np.searchsorted(columns, pos)
                use = columns[np.minimum(place, len(columns) - 1)] == pos if len(columns) else np.zeros(len(pos), bool)
                z = np.zeros((batch.num_rows, width))
                z[:, 0], z[:, -1] = 1.0, batch.column("y").to_numpy()
                z[at[use], place[use] + 1] = value[use]
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["r", "sums"])

    partial = rows.select("pos", "value", F.col("y").cast("double").alias("y")).mapInArrow(work, "r int, sums array<double>")
    return _added(partial.select(F.lit(0).alias("i"), F.lit(0).alias("j"), "r", "sums"), ["i", "j", "r"])


def column_means(rows: DataFrame, width: int) -> np.ndarray:
    """The mean of every column, by one pass."""
    if not is_sparse(rows):
        return rows.agg(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"].toArray()
    n, _, sums = gradient(rows.withColumn("y", F.lit(0.0)), 1.0, np.zeros(width))
    return sums / n


def by_group(sums: DataFrame, by: list[str], solve: Callable[[np.ndarray, tuple], pd.DataFrame], schema: str) -> DataFrame:
    """``solve`` on each group's whole matrix (one block: its size is bounded by ``BLOCK``), in its own task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r")
        return solve(np.stack(pdf["sums"].to_numpy()), tuple(pdf[c].iloc[0] for c in by))

    return (sums.groupBy(*by) if by else sums.withColumn("_all", F.lit(0)).groupBy("_all")).applyInPandas(work, schema)


def gradient(rows: DataFrame, intercept: float, a: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(sum of e, sum of e * e, X'e) with e = intercept + Xa - y, by one pass over ``rows``, dense or sparse."""
    weights = np.asarray(a, dtype=float)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(weights) + 2)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                e = intercept + x @ weights - pdf["y"].to_numpy()
                total += np.concatenate([[e.sum(), e @ e], e @ x])
        yield pd.DataFrame({"v": [total]})

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 2)
        for batch in batches:
            at, pos, value = sparse_cells(batch)
            e = intercept + np.bincount(at, value * weights[pos], batch.num_rows) - batch.column("y").to_numpy()
            total += np.concatenate([[e.sum(), e @ e], np.bincount(pos, value * e[at], len(weights))])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    y = F.col("y").cast("double").alias("y")
    if is_sparse(rows):
        parts = rows.select("pos", "value", y).mapInArrow(sparse, "v array<double>")
    else:
        parts = rows.select("x", y).mapInPandas(work, "v array<double>")
    parts = parts.select(array_to_vector("v").alias("v"))
    first = parts.withColumn("g", F.spark_partition_id() % FAN_IN).groupBy("g").agg(Summarizer.sum(F.col("v")).alias("v"))
    out = first.agg(Summarizer.sum(F.col("v")).alias("v")).first()["v"].toArray()
    return float(out[0]), float(out[1]), out[2:]


# --- elastic net --------------------------------------------------------------------------


def _split(full: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """n, means, mean of y, and the centred sums xx, xy, yy of a matrix of (1, x, y)."""
    n = full[0, 0]
    mx, my = full[0, 1:-1] / n, full[0, -1] / n
    return n, mx, my, full[1:-1, 1:-1] - n * np.outer(mx, mx), full[1:-1, -1] - n * mx * my, full[-1, -1] - n * my * my


def elastic_net(c: np.ndarray, b: np.ndarray, alpha: float, l1: float, start: np.ndarray | None = None, rounds: int = 10_000, tol: float = 1e-10) -> np.ndarray:
    """min 0.5 w'Cw - b'w + alpha * l1 * |w| + 0.5 * alpha * (1 - l1) * w'w.

    A round descends once in every coefficient, which finds the columns in use and their signs, then moves
    those to the least squares solution of these signs, or as far as the first that would change sign. Both only
    lower the objective, and columns that nearly add up to nothing cost no extra rounds."""
    p = len(b)
    t, ridge = alpha * l1, alpha * (1 - l1)
    if not t:
        return np.linalg.lstsq(c + alpha * np.eye(p), b, rcond=None)[0]
    w = np.zeros(p) if start is None else start.copy()
    scale = np.diag(c) + ridge
    some = np.flatnonzero(scale > 0)
    for _ in range(rounds):
        r = b - c @ w
        for j in some:
            old, g = w[j], r[j] + c[j, j] * w[j]
            w[j] = math.copysign(max(abs(g) - t, 0.0), g) / scale[j]
            if w[j] != old:
                r -= c[j] * (w[j] - old)
        used = np.flatnonzero(w)
        signs = np.sign(w[used])
        if len(used):
            goal = np.linalg.lstsq(c[np.ix_(used, used)] + ridge * np.eye(len(used)), b[used] - t * signs, rcond=None)[0]
            turned = np.sign(goal) != signs
            reach = w[used][turned] / (w[used][turned] - goal[turned])
            step = float(reach.min(initial=1.0))
            w[used] += step * (goal - w[used])
            if turned.any():
                w[used[turned][reach == step]] = 0.0
        g = b - c @ w - ridge * w
        off = np.where(w == 0, np.maximum(np.abs(g) - t, 0.0), np.abs(g - t * np.sign(w)))
        if off[some].max(initial=0.0) <= tol * max(t, float(np.abs(b).max(initial=0.0))):
            break
    return w


def linear_trial(train: np.ndarray, alpha: float, l1: float, start: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, weights on the raw columns, and on z-scores, of the elastic net of one penalty."""
    n, mx, my, xx, xy, _ = _split(train)
    spread = np.sqrt(np.maximum(np.diag(xx), 0.0) / n)
    flat = spread <= 1e-12 * np.maximum(1.0, np.abs(mx))
    inverse = np.where(flat, 0.0, 1.0 / np.where(flat, 1.0, spread))
    w = elastic_net(xx * inverse[:, None] * inverse[None, :] / n, xy * inverse / n, alpha, l1, start)
    return my - mx @ (w * inverse), w * inverse, w


def linear_scores(sums: np.ndarray, intercept: float, w: np.ndarray) -> dict[str, float | None]:
    """rmse, r2 and pearson of a linear model over the rows that ``sums`` were taken from."""
    n, mx, my, xx, xy, yy = _split(sums)
    yy, pp, cov = max(yy, 0.0), max(float(w @ xx @ w), 0.0), float(xy @ w)
    sse = max(yy - 2 * cov + pp, 0.0) + n * (intercept + mx @ w - my) ** 2
    spread = math.sqrt(yy) * math.sqrt(pp)
    r2 = 1 - sse / yy if yy > 0 else (1.0 if sse == 0 else 0.0)
    return {
        "rmse": math.sqrt(sse / n), "r2": r2 if n >= 2 else None,
        "pearson": max(-1.0, min(1.0, cov / spread)) if spread > 1e-12 * max(yy, 1e-300) else None,
    }


def linear_trials(design: DataFrame, trials: list[tuple[str, float, float]], block: int = BLOCK) -> DataFrame:
    """trial, fit, metric, value, w of elastic nets for every (trial, alpha, l1_ratio) and every ``fit`` of ``design``
    (fit, split, x, y), from one pass: its sums per fit and split. ``w`` (intercept, then weights on the raw
    columns) stands on the row of metric ``weights``."""
    ordered = sorted(trials, key=lambda t: (-t[2], -t[1]))  # warm starts from the strongest penalty down

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {s: np.stack(some.sort_values("r")["sums"].to_numpy()) for s, some in pdf.groupby("split")}
        out, start = [], None
        if "train" not in parts:
            return pd.DataFrame({"trial": [], "fit": [], "metric": [], "value": [], "w": []})
        fit = int(pdf["fit"].iloc[0])
        for trial, alpha, l1 in ordered:
            intercept, w, start = linear_trial(parts["train"], alpha, l1, start)
            out.append((trial, fit, "weights", None, [float(intercept), *w.tolist()]))
            for split, sums in parts.items():
                out += [(trial, fit, f"{m}_{split}", v, None) for m, v in linear_scores(sums, intercept, w).items()]
        return pd.DataFrame(out, columns=["trial", "fit", "metric", "value", "w"])

    sums = gram(design, ["fit", "split"], block)
    return sums.groupBy("fit").applyInPandas(solve, "trial string, fit int, metric string, value double, w array<double>")
