"""Gradient-boosted trees from sums of gradients and hessians, grown level by level.

Rows are binned once (exact bounds of at most ``BINS`` bins to a column) and written. For each level of a round's
trees one pass adds up gradient and hessian by (tree, column, node, bin); Spark sums the passes' arrays, finds
each column's best cut in tasks and the best column by an aggregate, and only the chosen cuts (one for each node)
reach the driver. The trees of a round, one for each class and parallel tree, grow in the same passes.

With G and H the sums of gradients and hessians of a node's rows, T(G) = sign(G) * max(|G| - reg_alpha, 0):

    leaf weight   -T(G) / (H + reg_lambda), times eta / num_parallel_tree
    gain of a cut 0.5 * (T(GL)^2 / (HL + reg_lambda) + T(GR)^2 / (HR + reg_lambda) - T(G)^2 / (H + reg_lambda)) - gamma
    allowed only  if HL and HR are min_child_weight at least, and the gain is above 0

Squared error for numbers, logistic loss for two classes, softmax for more. ``subsample`` draws rows anew for each
tree by a hash of row, round and tree, ``colsample`` columns likewise. With validation rows the first pass of
a round also adds up their loss; growing ends once the best round has not been beaten for the patience given.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.session import materialize, release

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 64
ACCURACY = 10_000  # of the quantiles that bound the bins
REBASE = 16  # rounds after which margins are written anew
CHUNK_BYTES = 32_000_000  # of binned rows added up at once
LOSS = -1  # stands for a column in the rows that carry the validation loss
EPS = 1e-15


@dataclass
class Tree:
    """Nodes in arrays; ``column`` is -1 at a leaf, else rows with bin <= ``cut`` go left."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: int) -> tuple[int, int]:
        self.column[node], self.cut[node] = column, cut
        self.left[node], self.right[node] = len(self.column), len(self.column) + 1
        for values, blank in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            values += [blank, blank]
        return self.left[node], self.right[node]

    def arrays(self):
        return tuple(np.array(v) for v in (self.column, self.cut, self.left, self.right, self.value))


def walk(arrays: tuple, cells: np.ndarray) -> np.ndarray:
    """The node in which each row ends; ``cells`` and cuts are on one scale (bins, or raw values and bounds)."""
    column, cut, left, right = arrays[:4]
    node = np.zeros(len(cells), np.int64)
    at = np.arange(len(cells))
    while True:
        inner = column[node] >= 0
        if not inner.any():
            return node
        rows, here = at[inner], node[inner]
        node[inner] = np.where(cells[rows, column[here]] <= cut[here], left[here], right[here])


def bounds(rows: DataFrame, width: int, bins: int = BINS) -> list[list[float]]:
    """Of each column the upper bounds of its bins but the last, from one pass over the cells."""
    shares = F.lit([float(q) for q in np.arange(1, bins) / bins])
    cells = rows.select(F.posexplode(vector_to_array("features")).alias("j", "v"))
    # a sketch of bounded size for each column; its quantiles are values of the column
    found = cells.groupBy("j").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, ACCURACY))).alias("cuts"), F.max("v").alias("most"))
    out: list[list[float]] = [[] for _ in range(width)]
    for r in found.toLocalIterator():  # as many numbers as the model's own description of its columns
        out[r["j"]] = [c for c in r["cuts"] if c < r["most"]]
    return out


def binned(rows: DataFrame, cuts: list[list[float]], margins: np.ndarray) -> DataFrame:
    """Written: id, val, y, cells (one byte a column), margin (one number for each output)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                cells = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)
                yield pd.DataFrame({"id": pdf["id"], "val": pdf["val"], "y": pdf["y"], "cells": [r.tobytes() for r in cells], "margin": [margins] * len(x)})

    df = rows.select(F.monotonically_increasing_id().alias("id"), "val", F.col("label").cast("double").alias("y"), vector_to_array("features").alias("x"))
    return materialize(df.mapInPandas(work, "id long, val boolean, y double, cells binary, margin array<double>"))


def gradients(objective: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and hessian [row, output] and the loss of each row."""
    if objective == "squared":
        e = margin[:, 0] - y
        return e[:, None], np.ones((len(y), 1)), e * e
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin[:, 0]))
        chosen = np.where(y > 0.5, p, 1 - p)
        return (p - y)[:, None], np.maximum(p * (1 - p), EPS)[:, None], -np.log(np.maximum(chosen, EPS))
    shifted = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = shifted / shifted.sum(axis=1, keepdims=True)
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y.astype(int)] = 1.0
    return p - hit, np.maximum(2 * p * (1 - p), EPS), -np.log(np.maximum((p * hit).sum(axis=1), EPS))


def _drawn(seed: int, numbers: np.ndarray, share: float) -> np.ndarray:
    """A fixed pseudo-random choice among ``numbers``."""
    if share >= 1.0:
        return np.ones(len(numbers), bool)
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**63)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64 < share


def _chunks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple]:
    some, size = [], 0
    for pdf in batches:
        if len(pdf):
            some.append(pdf)
            size += len(pdf) * max(width, 1)
        if size >= CHUNK_BYTES:
            yield pd.concat(some)
            some, size = [], 0
    if some:
        yield pd.concat(some)


def _unpacked(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    cells = np.frombuffer(b"".join(pdf["cells"]), np.uint8).reshape(len(pdf), width)
    return cells, np.stack(pdf["margin"].to_numpy())


def _grown(margin: np.ndarray, cells: np.ndarray, done: list[tuple[int, tuple]]) -> np.ndarray:
    margin = margin.copy()
    for output, arrays in done:
        margin[:, output] += arrays[4][walk(arrays, cells)]
    return margin


@dataclass
class Round:
    """What a pass needs: finished trees since the margins were written, and the trees that grow."""

    objective: str
    width: int
    done: list[tuple[int, tuple]]
    growing: list[tuple]
    per_output: int
    frontier: list[list[int]]
    seeds: list[int]
    subsample: float
    columns: list[np.ndarray]


def _histograms(r: Round, with_loss: bool):
    """tree, j, sums: gradients then hessians by (frontier node, bin); column LOSS: the validation rows' loss and count."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(batches, r.width):
            cells, margin = _unpacked(pdf, r.width)
            y, val, ids = pdf["y"].to_numpy(), pdf["val"].to_numpy(dtype=bool), pdf["id"].to_numpy()
            g, h, loss = gradients(r.objective, y, _grown(margin, cells, r.done))
            if with_loss and val.any():
                yield pd.DataFrame({"tree": [0], "j": [LOSS], "sums": [np.array([loss[val].sum(), val.sum()], float)]})
            for t, arrays in enumerate(r.growing):
                if not r.frontier[t]:
                    continue
                place = np.full(len(arrays[0]), -1)
                place[r.frontier[t]] = np.arange(len(r.frontier[t]))
                node = place[walk(arrays, cells)]
                use = ~val & (node >= 0) & _drawn(r.seeds[t], ids, r.subsample)
                node, some = node[use] * BINS, cells[use]
                gt, ht = g[use, t // r.per_output], h[use, t // r.per_output]
                size = len(r.frontier[t]) * BINS
                for at in range(0, len(r.columns[t]), 64):
                    js = r.columns[t][at : at + 64]
                    sums = [np.concatenate([np.bincount(node + some[:, j], w, size) for w in (gt, ht)]) for j in js]
                    yield pd.DataFrame({"tree": np.full(len(js), t), "j": js, "sums": sums})

    return work


def _thresholded(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def worth(g, h, alpha: float, lam: float):
    """T(G)^2 / (H + lambda)."""
    return np.where(h + lam > 0, _thresholded(g, alpha) ** 2 / np.where(h + lam > 0, h + lam, 1.0), 0.0)


def weight(g: float, h: float, alpha: float, lam: float) -> float:
    return float(-_thresholded(np.array(g), alpha) / (h + lam)) if h + lam > 0 else 0.0


def _best_cuts(alpha: float, lam: float, gamma: float, least: float):
    """tree, node, gain, j, cut, gl, hl, gr, hr: the best cut of each column for each frontier node; also j LOSS."""
    names = ["tree", "node", "gain", "j", "cut", "gl", "hl", "gr", "hr"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tree, j, sums in zip(pdf["tree"], pdf["j"], pdf["sums"]):
                if j == LOSS:
                    out.append((tree, -1, 0.0, j, 0, sums[0], sums[1], 0.0, 0.0))
                    continue
                g, h = np.asarray(sums).reshape(2, -1, BINS)
                gl, hl = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = 0.5 * (worth(gl, hl, alpha, lam) + worth(gt - gl, ht - hl, alpha, lam) - worth(gt, ht, alpha, lam)) - gamma
                gain[(hl < least) | (ht - hl < least) | (hl <= 1e-12) | (ht - hl <= 1e-12)] = -np.inf
                cut = gain.argmax(axis=1)
                for node in range(len(g)):
                    c = cut[node]
                    best = float(gain[node, c])
                    # equal columns must tie, whatever order their rows were added in
                    best = float(f"{best:.9e}") if math.isfinite(best) else -1e300
                    out.append((tree, node, best, j, int(c), gl[node, c], hl[node, c], gt[node, 0] - gl[node, c], ht[node, 0] - hl[node, c]))
            yield pd.DataFrame(out, columns=names)

    return work


CUTS = "tree int, node int, gain double, j int, cut int, gl double, hl double, gr double, hr double"


def _level(rows: DataFrame, r: Round, with_loss: bool, p: dict) -> dict[tuple[int, int], dict]:
    """The best cut of every frontier node of every tree, and under (0, -1) the validation loss."""
    hist = rows.mapInPandas(_histograms(r, with_loss), "tree int, j int, sums array<double>").select("tree", "j", array_to_vector("sums").alias("v"))
    summed = hist.groupBy("tree", "j").agg(Summarizer.sum(F.col("v")).alias("v")).select("tree", "j", vector_to_array("v").alias("sums"))
    cuts = summed.mapInPandas(_best_cuts(p["reg_alpha"], p["reg_lambda"], p["gamma"], p["min_child_weight"]), CUTS)
    best = F.max_by(F.struct("gain", "j", "cut", "gl", "hl", "gr", "hr"), F.struct(F.col("gain"), -F.col("j")))
    return {(x["tree"], x["node"]): x["b"].asDict() for x in cuts.groupBy("tree", "node").agg(best.alias("b")).collect()}


def _rebased(rows: DataFrame, done: list[tuple[int, tuple]], width: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cells, margin = _unpacked(pdf, width)
                yield pdf.assign(margin=list(_grown(margin, cells, done)))

    return materialize(rows.mapInPandas(work, rows.schema))


def settings(params: dict) -> dict:
    given = {k: v for k, v in params.items() if v is not None}
    return {
        "n_estimators": int(given["n_estimators"]), "max_depth": int(given.get("max_depth", 6)), "eta": float(given.get("eta", 0.1)),
        "gamma": float(given.get("gamma", 0.0)), "reg_alpha": float(given.get("reg_alpha", 0.0)), "reg_lambda": float(given.get("reg_lambda", 1.0)),
        "min_child_weight": float(given.get("min_child_weight", 1.0)), "num_parallel_tree": int(given.get("num_parallel_tree", 1)),
        "subsample": float(given.get("subsample", 1.0)), "colsample": float(given.get("colsample", 1.0)),
    }


def _start(train: DataFrame, objective: str, n_classes: int | None) -> list[float]:
    """Margins before the first tree: the mean, or what gives the classes' shares."""
    if objective == "squared":
        return [float(train.agg(F.avg("label")).first()[0])]
    counts = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}  # one row for each class
    total = sum(counts.values())
    shares = [max(counts.get(k, 0) / total, 1e-6) for k in range(max(n_classes, 2))]
    return [math.log(shares[1] / shares[0])] if objective == "logistic" else [math.log(s) for s in shares]


def fit_boosted(
    train: DataFrame, val: DataFrame | None, params: dict, seed: int, n_classes: int | None, stop: Callable[[list[float]], int | None]
) -> tuple[dict, int | None]:
    """The model's description (plain lists) and the round that ``stop`` found best, if it did, on ``val``."""
    p = settings(params)
    objective = "squared" if n_classes is None else "logistic" if n_classes <= 2 else "softmax"
    start = _start(train, objective, n_classes)
    width = train.select(F.size(vector_to_array("features")).alias("w")).first()["w"]
    cuts = bounds(train, width)
    rows = train.select("features", "label").withColumn("val", F.lit(False))
    if val is not None:
        rows = rows.unionByName(val.select("features", "label").withColumn("val", F.lit(True)))
    rows = binned(rows, cuts, np.array(start))
    outputs, per_output = len(start), p["num_parallel_tree"]
    kept: list[tuple[int, Tree]] = []
    recent: list[tuple[int, tuple]] = []
    losses: list[float] = []
    best = None
    rate = p["eta"] / per_output
    for number in range(p["n_estimators"] + (val is not None)):  # with validation rows one more pass tells the last round's loss
        last = number == p["n_estimators"]
        trees = [Tree() for _ in range(outputs * per_output)]
        seeds = [(seed * 1_000_003 + number) * 1_009 + t for t in range(len(trees))]
        columns = [np.flatnonzero(_drawn(s * 31 + 7, np.arange(width), p["colsample"])).astype(np.int32) for s in seeds]
        columns = [c if len(c) else np.array([s % max(width, 1)], np.int32) for c, s in zip(columns, seeds)]
        frontier = [[0] for _ in trees]
        for depth in range(p["max_depth"]):
            r = Round(objective, width, recent, [t.arrays() for t in trees], per_output, frontier, seeds, p["subsample"], columns)
            found = _level(rows, r, depth == 0 and val is not None, p)
            if depth == 0 and (0, -1) in found and number:
                loss = found.pop((0, -1))
                losses.append(loss["gl"] / loss["hl"])
                best = stop(losses)
                if best is not None or last:
                    break
            found.pop((0, -1), None)
            nxt: list[list[int]] = [[] for _ in trees]
            for (t, place), c in sorted(found.items()):
                tree, node = trees[t], frontier[t][place]
                if depth == 0:
                    tree.value[0] = rate * weight(c["gl"] + c["gr"], c["hl"] + c["hr"], p["reg_alpha"], p["reg_lambda"])
                if c["gain"] > 0:
                    ends = tree.split(node, c["j"], c["cut"])
                    for end, g, h in zip(ends, (c["gl"], c["gr"]), (c["hl"], c["hr"])):
                        tree.value[end] = rate * weight(g, h, p["reg_alpha"], p["reg_lambda"])
                    nxt[t] += ends
            frontier = nxt
            if not any(frontier):
                break
        if best is not None or last:
            break
        grown = [(t // per_output, tree) for t, tree in enumerate(trees)]
        kept += grown
        recent = recent + [(o, tree.arrays()) for o, tree in grown]
        if (number + 1) % REBASE == 0:
            old, rows = rows, _rebased(rows, recent, width)
            release(old)
            recent = []
    release(rows)
    if best is not None:
        kept = kept[: (best + 1) * outputs * per_output]
    described = [
        {"output": o, "column": t.column, "bound": [cuts[j][c] if j >= 0 else 0.0 for j, c in zip(t.column, t.cut)], "left": t.left, "right": t.right, "value": t.value}
        for o, t in kept
    ]
    return {"objective": objective, "start": start, "trees": described, "losses": losses}, best


def margins(described: dict, x: Column) -> Column:
    """array<double>: the outputs of the model on dense rows ``x``."""
    trees = [(t["output"], tuple(np.array(t[k]) for k in ("column", "bound", "left", "right", "value"))) for t in described["trees"]]
    start = np.array(described["start"])

    @F.pandas_udf("array<double>")
    def outputs(x: pd.Series) -> pd.Series:
        cells = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        return pd.Series(list(_grown(np.tile(start, (len(cells), 1)), cells, trees)), index=x.index)

    return outputs(x)
