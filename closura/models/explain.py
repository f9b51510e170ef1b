"""Coefficients and attributions of fitted models."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.models.estimators import Fitted, to_features
from closura.operators.ordered import hash_order
from closura.session import materialize

BLOCK = 64  # background rows of a block
COEF_MODELS = ("linreg", "logreg", "log_contrast")
SUMS = ("linreg", "log_contrast")  # their output is linear in the columns


def _coef_matrix(fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """(classes x p, intercepts) in the scale the model was fitted on."""
    if fitted.kind == "log_contrast":
        return np.array([fitted.meta["coef"]]), np.array([fitted.meta["intercept"]])
    if fitted.kind not in COEF_MODELS:
        raise TypeError("coefficients exist for linreg, logreg and log_contrast only")
    m = fitted.stages["main"].stages[-1]
    if fitted.kind == "linreg":
        return m.coefficients.toArray()[None, :], np.array([m.intercept])
    return m.coefficientMatrix.toArray(), m.interceptVector.toArray()


def coefficients(spark: SparkSession, fitted: Fitted, names: list[str], classes: list[str] | None = None) -> DataFrame:
    """feature, coefficient, abs_coefficient; with several classes also ``class``.
    A model's parameters are p x classes numbers."""
    coef, _ = _coef_matrix(fitted)
    if coef.shape[1] != len(names):
        raise ValueError(f"{coef.shape[1]} coefficients for {len(names)} features.")
    if len(coef) == 1:
        rows = [(f, float(v), float(abs(v))) for f, v in zip(names, coef[0])]
        return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double")
    labels = classes if classes and len(classes) == len(coef) else [f"class_{i}" for i in range(len(coef))]
    rows = [(f, c, float(v), float(abs(v))) for c, line in zip(labels, coef) for f, v in zip(names, line)]
    return spark.createDataFrame(rows, "feature string, class string, coefficient double, abs_coefficient double")


def raw_weights(fitted: Fitted) -> np.ndarray:
    """Weights on the unscaled features (classes x p)."""
    coef, _ = _coef_matrix(fitted)
    if fitted.kind == "log_contrast":
        return coef
    scaler, product = fitted.stages["main"].stages[0], fitted.stages["main"].stages[1]
    std = scaler.std.toArray()
    up = np.array(product.getScalingVec().toArray())
    return coef * np.where(std > 0, up / np.where(std > 0, std, 1.0), 0.0)


def linear_shap(rows: DataFrame, background: DataFrame, weights: np.ndarray, names: list[str], classes: list[str]) -> DataFrame:
    """(sample_id, class, feature, phi) with phi = w_j (x_j - mean_j of the background).

    The means are one vector of the design's width; everything else happens within the row."""
    mean = background.select(Summarizer.mean(array_to_vector("x")).alias("m")).first()["m"]
    if mean is None:
        raise ValueError("empty background")
    # class by class, the weights and the products w_j mean_j as one literal row
    lines = F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit([float(v) for v in w]).alias("w"), F.lit([float(v) for v in mean]).alias("m")) for c, w in zip(classes, weights)
    ])
    line = rows.select("sample_id", "x", F.explode(lines).alias("l")).select("sample_id", "x", "l.*")
    centred = F.zip_with("x", "m", lambda v, mu: v - mu)
    phi = F.zip_with("w", centred, lambda w, d: w * d)
    return line.select("sample_id", "class", F.posexplode(phi).alias("j", "phi")).select(
        "sample_id", "class", F.get(F.lit(list(names)), F.col("j")).alias("feature"), "phi"
    )


def shapley_sample(
    fitted: Fitted, rows: DataFrame, background: DataFrame, names: list[str], classes: list[str],
    n_perm: int = 8, max_background: int | None = None, seed: int = 0,
) -> DataFrame:
    """Sampled Shapley values of any model: (sample_id, class, feature, phi).

    Features are switched from a background row to the sample one after another, in an order drawn
    by hash for each background row; a feature's value is the mean change of the output. Every
    background row is used equally often (``n_perm`` orders in all, at least one for each row), so
    the values of a sample add up to its output less the mean output over the background. All
    background rows count unless ``max_background`` bounds them (the smallest hashes).

    A sample meets the background in blocks of ``BLOCK`` rows by an ordinary join on the block. Where the output is a sum of
    weighted columns (``SUMS``), a switch changes it by the weight times the two cells' difference in whatever order: the mean
    over all orders and background rows is the weight times the distance from the background's mean, one pass for each side.
    """
    p = len(names)
    if fitted.kind in SUMS and max_background is None:
        return linear_shap(rows, background, raw_weights(fitted), names, classes)
    back = background.select(hash_order(seed, F.col("sample_id")).alias("h"), F.col("sample_id").alias("bg"), F.col("x").alias("b"))
    if max_background is not None:
        back = back.orderBy("h", "bg").limit(max_background)
    back = materialize(back)
    m = back.count()
    if not m:
        raise ValueError("empty background")
    blocks, rounds = -(-m // BLOCK), -(-n_perm // m)
    place = F.pmod(F.col("h"), F.lit(blocks)).cast("int")
    turns = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: F.struct(F.xxhash64(F.lit(seed), "bg", "round", j), j.alias("j")))
    drawn = back.select("bg", "b", place.alias("block"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    drawn = drawn.withColumn("ord", F.transform(F.array_sort(turns), lambda t: t["j"]))
    # place[j]: the turn (from 1) at which feature j is switched
    drawn = drawn.withColumn("place", F.transform(F.array_sort(F.transform("ord", lambda j, i: F.struct(j.alias("j"), (i + 1).alias("i")))), lambda t: t["i"]))
    asked = rows.select("sample_id", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    steps = asked.join(drawn, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(p))))
    mixed = F.transform(
        F.arrays_zip(F.col("x").alias("x"), F.col("b").alias("b"), F.col("place").alias("t")),
        lambda z: F.when(z["t"] <= F.col("turn"), z["x"]).otherwise(z["b"]),
    )
    scored = fitted.score(steps.select("sample_id", "turn", "ord", to_features(mixed, fitted.kind).alias("features")))
    out = F.col("proba") if fitted.has_proba else F.array("prediction")
    # a step's change needs the step before: both sides of the difference are emitted and summed
    share = F.array(
        F.struct(F.col("turn").alias("turn"), F.lit(1.0).alias("s")), F.struct((F.col("turn") + 1).alias("turn"), F.lit(-1.0).alias("s"))
    )
    flat = scored.select("sample_id", "ord", out.alias("out"), F.explode(share).alias("d")).where(F.col("d.turn").between(1, p))
    return (
        flat.select(
            "sample_id", F.element_at("ord", F.col("d.turn")).alias("j"), "d.s",
            F.explode(F.arrays_zip(F.lit(list(classes)).alias("c"), F.col("out").alias("o"))).alias("z"),
        )
        .groupBy("sample_id", F.col("z.c").alias("class"), F.element_at(F.lit(list(names)), F.col("j") + 1).alias("feature"))
        .agg((F.sum(F.col("s") * F.col("z.o")) / (m * rounds)).alias("phi"))
    )
