"""Scores of predictions. Input rows: sample_id, model, split, label, pred[, proba]."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from closura.operators.ordered import ordered_prefix

BY = ["model", "split"]
# Fixed value: lower clip of a probability in the log loss.
PROBA_EPS = 2.220446049250313e-16


def stack_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test predictions under one ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def regression_metrics(preds: DataFrame) -> DataFrame:
    """rmse, r2, pearson and n per model and split, from one partial aggregation. Constant labels or
    predictions have no correlation: null."""
    y, p = F.col("label").cast("double"), F.col("pred").cast("double")
    sums = preds.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("sse"),
        F.var_pop(y).alias("vy"),
        F.var_pop(p).alias("vp"),
        F.covar_pop(y, p).alias("cov"),
    )
    sst = F.col("vy") * F.col("n")
    spread = F.sqrt("vy") * F.sqrt("vp")
    pearson = F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / spread)))
    r2 = F.when(sst > 0, 1 - F.col("sse") / sst).when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return sums.select(
        *BY, F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), F.when(F.col("n") >= 2, r2).alias("r2"), pearson.alias("pearson"), "n"
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs; 1 for n = 2."""
    if n is None or n < 2 or r is None or math.isnan(r):
        return float("nan")
    if n == 2:
        return 1.0
    return incomplete_beta(n / 2 - 1, 0.5, max(0.0, (1 - r) * (1 + r)))


def _p_values(r, n):
    return pd.Series(np.array([pearson_p(a, b) for a, b in zip(r, n)], dtype=float))


_p_values.__annotations__ = {"r": pd.Series, "n": pd.Series, "return": pd.Series}
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
_pearson_p = F.pandas_udf(_p_values, DoubleType())


def with_p_value(metrics: DataFrame) -> DataFrame:
    """Add pearson_pvalue to the (models x splits) metric rows."""
    return metrics.withColumn("pearson_pvalue", _pearson_p("pearson", "n"))


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy(*BY, "label", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Macro F1, balanced accuracy and multiclass MCC from confusion counts."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    truth = counts.select(*BY, F.col("label").alias("cls"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), hit.alias("tp"))
    guess = counts.select(*BY, F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp"))
    per_class = truth.unionByName(guess).groupBy(*BY, "cls").agg(*[F.sum(c).cast("double").alias(c) for c in ("t", "p", "tp")])
    s = per_class.groupBy(*BY).agg(
        F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))).alias("f1_macro"),
        F.avg(F.when(F.col("t") > 0, F.col("tp") / F.col("t"))).alias("balanced_accuracy"),
        F.sum("t").alias("s"),
        F.sum("tp").alias("c"),
        F.sum(F.col("t") * F.col("p")).alias("tp_"),
        F.sum(F.col("t") * F.col("t")).alias("tt"),
        F.sum(F.col("p") * F.col("p")).alias("pp"),
    )
    spread = (F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt"))
    mcc = F.when(spread > 0, (F.col("c") * F.col("s") - F.col("tp_")) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return s.select(*BY, "f1_macro", "balanced_accuracy", mcc.alias("mcc"))


def _class_array(classes: list[str]):
    return F.array(*[F.lit(c) for c in classes])


def log_loss(preds: DataFrame, classes: list[str], proba: str = "proba") -> DataFrame:
    """Mean negative log probability of the true class; rows are renormalised, then clipped."""
    total = F.aggregate(proba, F.lit(0.0), lambda a, v: a + v)
    p_true = F.element_at(F.col(proba), F.array_position(_class_array(classes), F.col("label")).cast("int")) / total
    clipped = F.least(F.greatest(p_true, F.lit(PROBA_EPS)), F.lit(1 - PROBA_EPS))
    return preds.groupBy(*BY).agg((-F.avg(F.ln(clipped))).alias("log_loss"))


def roc_auc_per_class(preds: DataFrame, classes: list[str], proba: str = "proba") -> DataFrame:
    """One-vs-rest area per class, ties counting half; NULL when a class is absent or alone.

    Rows are first collapsed by score, so a score shared by very many rows is one row of
    counts; the counts below each score come from a chunked prefix sum.
    """
    if len(classes) == 2:
        wide = preds.select(*BY, "label", F.lit(classes[1]).alias("cls"), F.element_at(proba, 2).alias("score"))
    else:
        pairs = F.arrays_zip(_class_array(classes).alias("c"), F.col(proba).alias("s"))
        wide = preds.select(*BY, "label", F.explode(pairs).alias("z")).select(
            *BY, "label", F.col("z.c").alias("cls"), F.col("z.s").alias("score")
        )
    positive = (F.col("label") == F.col("cls")).cast("double")
    scores = wide.groupBy(*BY, "cls", "score").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    below = ordered_prefix(scores, [*BY, "cls"], [F.col("score")], value="neg")
    area = F.sum(F.col("pos") * (F.col("cum") - F.col("neg") / 2))
    pairs_total = F.sum("pos") * F.sum("neg")
    return below.groupBy(*BY, "cls").agg(F.when(pairs_total > 0, area / pairs_total).alias("auc"))


def roc_auc(preds: DataFrame, classes: list[str], proba: str = "proba") -> DataFrame:
    """Binary or macro one-vs-rest area; NULL when any class's area is undefined."""
    per = roc_auc_per_class(preds, classes, proba)
    need = 1 if len(classes) == 2 else len(classes)
    return per.groupBy(*BY).agg(F.when(F.count("auc") == need, F.avg("auc")).alias("roc_auc_macro_ovr"))


def classification_metrics(preds: DataFrame, classes: list[str], proba: str = "proba") -> DataFrame:
    return (
        confusion_metrics(confusion(preds))
        .join(log_loss(preds, classes, proba), BY)
        .join(roc_auc(preds, classes, proba), BY)
    )


def attribution_summary(phi: DataFrame) -> DataFrame:
    """Mean absolute attribution per class and feature."""
    return phi.groupBy("class", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))


def top_features(table: DataFrame, value: str, n: int, by: str = "class") -> DataFrame:
    """The n largest |value| per class of a coefficient or attribution table (one row per feature)."""
    w = Window.partitionBy(by).orderBy(F.abs(value).desc(), "feature")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
