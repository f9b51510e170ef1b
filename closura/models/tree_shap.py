"""Exact interventional Shapley values of tree models against a whole background.

A leaf is reached by a mix of a sample x and a background row b if each column on its path meets the
path's conditions from whichever row it is taken. Only two bit patterns matter: which columns x meets and which
b meets. With A the columns that only x meets and B those that only b meets, a and b many, and none that
neither meets, the leaf's value goes to each column of A with (a - 1)! b! / (a + b)!, and is taken from each
of B with a! (b - 1)! / (a + b)!.

So the background is read once: Spark counts its patterns by (tree, leaf). Samples then meet those counts, not the
background's rows: blocks of samples are joined with blocks of counts by (group of trees, part), and each
leaf is worked out once for each pair of different patterns. Parts bound what a task holds.

The values of a sample add up to the model's output less its mean over the background. Outputs are predictions of
regression trees, class shares of forests, and for boosted classes the margins before the logistic or softmax.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.models.estimators import MISSING_SENTINEL, Fitted
from closura.session import materialize, scratch_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = 16  # trees to a group
PART = 50_000  # patterns to a part
SAMPLES = 256  # to a block
PAIRS = 2_000_000  # pairs of patterns worked out at once


def trees_of(spark: SparkSession, fitted: Fitted) -> list[dict]:
    """Each tree as lists: column (-1 at a leaf), bound (rows up to it go left), left, right, and value (one number for each output)."""
    if "boosted" in fitted.meta:
        model = fitted.meta["boosted"]
        outputs = len(model["start"])
        return [{**t, "value": np.eye(outputs)[t["output"]] * np.array(t["value"])[:, None]} for t in model["trees"]]
    if fitted.kind not in ("rf", "rf_class"):
        raise TypeError(f"{fitted.kind} is no tree model")
    # the library's own stored form of a forest: one row for each node
    path = f"{scratch_dir(spark)}/forest-{uuid.uuid4().hex}"
    fitted.stages["main"].stages[-1].write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # the model, which the driver holds anyway
    trees: dict[int, list] = {}
    for n in nodes:
        trees.setdefault(n["treeID"], []).append(n)
    out = []
    for some in trees.values():
        at = {n["id"]: i for i, n in enumerate(some)}
        inner = [n["leftChild"] >= 0 for n in some]
        if fitted.kind == "rf_class":
            k = fitted.meta["n_classes"]
            stats = [np.array(n["impurityStats"], float) for n in some]
            value = np.array([np.pad(s / max(s.sum(), 1e-300), (0, max(k - len(s), 0))) for s in stats])
        else:
            value = np.array([[n["prediction"]] for n in some])
        out.append({
            "column": [n["split"]["featureIndex"] if i else -1 for n, i in zip(some, inner)],
            "bound": [n["split"]["leftCategoriesOrThreshold"][0] if i else 0.0 for n, i in zip(some, inner)],
            "left": [at[n["leftChild"]] if i else 0 for n, i in zip(some, inner)], "right": [at[n["rightChild"]] if i else 0 for n, i in zip(some, inner)],
            "value": value / len(trees),
        })
    return out


def leaves_of(tree: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each leaf that says something: the columns on its path, the open lower and closed upper bound of each, its values."""
    out, waiting = [], [(0, {})]
    while waiting:
        node, path = waiting.pop()
        j = tree["column"][node]
        if j < 0:
            if path and np.any(tree["value"][node]):
                columns = sorted(path)
                low, high = np.array([path[c] for c in columns]).T
                out.append((np.array(columns), low, high, np.asarray(tree["value"][node], float)))
            continue
        low, high = path.get(j, (-math.inf, math.inf))
        bound = tree["bound"][node]
        waiting.append((tree["left"][node], {**path, j: (low, min(high, bound))}))
        waiting.append((tree["right"][node], {**path, j: (max(low, bound), high)}))
    return out


def patterns(leaf: tuple, x: np.ndarray) -> np.ndarray:
    """Bit d: the row meets the leaf's conditions on its d-th column."""
    columns, low, high, _ = leaf
    cells = x[:, columns]
    return ((cells > low) & (cells <= high)) @ (np.int64(1) << np.arange(len(columns), dtype=np.int64))


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["x"].to_numpy())
    return np.where(np.isnan(x), MISSING_SENTINEL, x)  # what trees see in place of a missing value


def _counted(leaves: list[list[tuple]]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _rows(pdf)
            for t, some in enumerate(leaves):
                for at, leaf in enumerate(some):
                    found, n = np.unique(patterns(leaf, x), return_counts=True)
                    yield pd.DataFrame({"tree": np.full(len(found), t), "leaf": np.full(len(found), at), "pattern": found, "n": n})

    return work


def shares(width: int, xs: np.ndarray, bs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[pattern of x, column]: what a leaf of value 1 gives each of its ``width`` columns, summed over the counted patterns."""
    fact = np.array([math.factorial(i) for i in range(width + 2)], float)
    out = np.zeros((len(xs), width))
    full = np.int64((1 << width) - 1)
    step = max(1, PAIRS // max(len(bs), 1))
    for at in range(0, len(xs), step):
        x, b = xs[at : at + step, None], bs[None, :]
        only_x, only_b = x & ~b, b & ~x
        alive = ((x | b) == full) * counts
        na, nb = np.bitwise_count(only_x).astype(np.int64), np.bitwise_count(only_b).astype(np.int64)
        given = alive * fact[np.maximum(na - 1, 0)] * fact[nb] / fact[na + nb]
        taken = alive * fact[na] * fact[np.maximum(nb - 1, 0)] / fact[na + nb]
        for d in range(width):
            out[at : at + step, d] = (given * ((only_x >> d) & 1)).sum(axis=1) - (taken * ((only_b >> d) & 1)).sum(axis=1)
    return out


def _attributed(leaves: list[list[tuple]], width: int, outputs: int):
    """sample_id, j, k, phi from blocks of samples and of counted patterns."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, raw, listed in zip(pdf["ids"], pdf["rows"], pdf["listed"]):
                x = np.frombuffer(raw, float).reshape(len(ids), width)
                tree, leaf, pattern, n = (np.array([r[c] for r in listed], np.int64) for c in ("tree", "leaf", "pattern", "n"))
                order = np.lexsort((leaf, tree))
                tree, leaf, pattern, n = tree[order], leaf[order], pattern[order], n[order]
                edges = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1]), [True]]))
                phi = np.zeros((len(ids), width, outputs))
                for a, b in zip(edges[:-1], edges[1:]):
                    one = leaves[tree[a]][leaf[a]]
                    xs, back = np.unique(patterns(one, x), return_inverse=True)
                    part = shares(len(one[0]), xs, pattern[a:b], n[a:b])[back]
                    phi[:, one[0], :] += part[:, :, None] * one[3][None, None, :]
                i, j, k = np.nonzero(phi)
                yield pd.DataFrame({"sample_id": np.array(ids, object)[i], "j": j.astype(np.int32), "k": k.astype(np.int32), "phi": phi[i, j, k]})

    return work


def _blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), SAMPLES):
            some = pdf.iloc[at : at + SAMPLES]
            yield pd.DataFrame({"ids": [list(some["sample_id"])], "rows": [_rows(some).tobytes()]})


def tree_shapley(fitted: Fitted, rows: DataFrame, background: DataFrame, names: list[str], classes: list[str]) -> DataFrame:
    """(sample_id, class, feature, phi) of every row (sample_id, x) against all of ``background`` (x)."""
    spark = rows.sparkSession
    trees = trees_of(spark, fitted)
    leaves = [leaves_of(t) for t in trees]
    outputs = len(trees[0]["value"][0]) if trees else 1
    if outputs == 1 and len(classes) == 2:
        classes = classes[1:]  # the margin of the second class
    if len(classes) != outputs:
        raise ValueError(f"{outputs} outputs for {len(classes)} classes.")
    m = background.count()
    if not m:
        raise ValueError("empty background")
    kind = rows.schema["sample_id"].dataType.simpleString()
    counted = background.select("x").mapInPandas(_counted(leaves), "tree int, leaf int, pattern long, n long")
    counted = materialize(counted.groupBy("tree", "leaf", "pattern").agg(F.sum("n").alias("n")).withColumn("trees", F.expr(f"tree div {GROUP}")))
    most = counted.groupBy("trees").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, math.ceil(most / PART))
    part = F.pmod(F.xxhash64("tree", "leaf", "pattern"), F.lit(parts)).cast("int").alias("part")
    listed = counted.groupBy("trees", part).agg(F.collect_list(F.struct("tree", "leaf", "pattern", "n")).alias("listed"))
    groups = max(1, math.ceil(len(trees) / GROUP))
    blocks = rows.select("sample_id", "x").mapInPandas(_blocked, f"ids array<{kind}>, rows binary")
    for name, size in (("trees", groups), ("part", parts)):
        blocks = blocks.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    met = blocks.join(listed.withColumn("trees", F.col("trees").cast("int")), ["trees", "part"])
    found = met.select("ids", "rows", "listed").mapInPandas(_attributed(leaves, len(names), outputs), f"sample_id {kind}, j int, k int, phi double")
    none = rows.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("j")).select(
        "sample_id", "j", F.explode(F.sequence(F.lit(0), F.lit(outputs - 1))).alias("k"), F.lit(0.0).alias("phi")
    )
    return found.unionByName(none).groupBy("sample_id", "j", "k").agg((F.sum("phi") / m).alias("phi")).select(
        "sample_id", F.get(F.lit(list(classes)), F.col("k")).alias("class"), F.get(F.lit(list(names)), F.col("j")).alias("feature"), "phi"
    )
