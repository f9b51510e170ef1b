"""MLlib fits behind one interface: ``fit_model(kind, train, params)`` -> ``Fitted``.

Frames carry ``features`` (Vector) and ``label`` (double; class or level index for
classifiers). Parameters use the search table's names; what MLlib cannot express is
ignored with a warning.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.functions.rows import argmax, corn_label, corn_proba, softmax
from closura.models.boosting import fit_boosted, margins

# Model types by task, and MLlib's limits.
REGRESSORS = ("linreg", "rf", "gbt", "log_contrast")
CLASSIFIERS = ("logreg", "rf_class", "gbt_class", "mlp_class")
ORDINAL = "ordinal"
TREES = ("rf", "rf_class", "gbt", "gbt_class")
MAX_TREE_DEPTH = 30
# stands for a missing value in tree models: below anything a feature can be
MISSING_SENTINEL = -1e300


@dataclass
class Fitted:
    """A fitted model: named MLlib stages plus plain settings."""

    kind: str
    stages: dict[str, PipelineModel]
    meta: dict = field(default_factory=dict)

    @property
    def has_proba(self) -> bool:
        return self.kind in CLASSIFIERS or self.kind == ORDINAL

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classifiers, ``proba`` (array<double>)."""
        return _score(self, rows)


def to_features(x: Column, kind: str) -> Column:
    """Dense array to Vector; trees get a sentinel for NaN."""
    if kind in TREES:
        x = F.transform(x, lambda v: F.when(F.isnan(v) | v.isNull(), F.lit(MISSING_SENTINEL)).otherwise(v))
    return array_to_vector(x)


def _scaler(train: DataFrame, n: int) -> PipelineModel:
    """z-scores with the population deviation (MLlib's scaler divides by the sample one)."""
    s = StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True).fit(train)
    up = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    width = s.mean.size
    e = ElementwiseProduct(scalingVec=Vectors.dense([up] * width), inputCol="_z", outputCol="scaled")
    return PipelineModel([s, e])


def _linreg(train, p, n, width, seed):
    alpha, l1 = float(p["alpha"]), float(p["l1_ratio"])
    scale = _scaler(train, n)
    # one solver at every width; it scales the label by s before penalising: undo it so that alpha and l1_ratio keep their meaning
    s = train.agg(F.stddev_samp("label")).first()[0] or 1.0
    lam = alpha * (l1 + s * (1 - l1))
    est = LinearRegression(
        featuresCol="scaled", regParam=lam, elasticNetParam=(alpha * l1 / lam if lam > 0 else 0.0),
        standardization=False, solver="l-bfgs", maxIter=1000, tol=1e-12,
    )
    return {"main": PipelineModel([*scale.stages, est.fit(scale.transform(train))])}, {}


def _logreg(train, p, n, width, seed):
    penalty = p.get("penalty") or "l2"
    mix = {"l2": 0.0, "l1": 1.0}.get(penalty, float(p.get("l1_ratio") or 0.0))
    scale = _scaler(train, n)
    est = LogisticRegression(
        featuresCol="scaled", regParam=1.0 / (float(p["C"]) * n), elasticNetParam=mix, standardization=False,
        family="auto", maxIter=1000, tol=1e-9,
    )
    return {"main": PipelineModel([*scale.stages, est.fit(scale.transform(train))])}, {}


def _depth(value) -> int:
    """None: as deep as MLlib grows trees."""
    if value is None:
        return MAX_TREE_DEPTH
    if int(value) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth={value} is beyond MLlib's limit of {MAX_TREE_DEPTH}")
    return int(value)


def _subset(value) -> str:
    return "all" if value is None else str(value)


def _forest(cls):
    def fit(train, p, n, width, seed):
        if p.get("min_samples_split") is not None:
            warnings.warn("min_samples_split has no MLlib counterpart and is ignored.")
        est = cls(
            numTrees=int(p["n_estimators"]), maxDepth=_depth(p.get("max_depth")), seed=seed,
            minInstancesPerNode=max(1, math.ceil(float(p.get("min_samples_leaf") or 0) * n)),
            minWeightFractionPerNode=float(p.get("min_weight_fraction_leaf") or 0.0),
            minInfoGain=float(p.get("min_impurity_decrease") or 0.0),
            featureSubsetStrategy=_subset(p.get("max_features")),
            bootstrap=bool(p.get("bootstrap", True)),
        )
        return {"main": PipelineModel([est.fit(train)])}, {}

    return fit


def patience(rounds: int) -> int:
    return max(10, int(0.1 * rounds))


def first_unbeaten(losses: list[float], wait: int) -> int | None:
    """Index of the first minimum that the next ``wait`` rounds do not improve on; None if the
    rounds end before that is known."""
    best, at = math.inf, -1
    for i, v in enumerate(losses):
        if v < best:
            best, at = v, i
        elif i - at >= wait:
            return at
    return None


def _boosted(train, p, seed, val, n_classes=None):
    """Early stopping while growing: the best round so far ends the fit once it stood for the patience."""
    wait = patience(int(p["n_estimators"]))
    described, best = fit_boosted(train, val, p, seed, n_classes, lambda losses: first_unbeaten(losses, wait))
    return {}, {"boosted": described, "best_iter": best}


def _fit_mlp(train, p, n, width, seed, n_classes):
    scale = _scaler(train, n)
    hidden = [int(p.get("width", 64))] * int(p.get("n_hidden_layers", 1))
    est = MultilayerPerceptronClassifier(
        featuresCol="scaled", layers=[width, *hidden, n_classes], maxIter=int(p.get("epochs", 100)),
        blockSize=int(p.get("batch_size", 128)), seed=seed,
    )
    return {"main": PipelineModel([*scale.stages, est.fit(scale.transform(train))])}, {}


def _fit_ordinal(train, p, n, width, n_classes):
    """One conditional logistic fit per threshold: P(y >= k | y >= k - 1)."""
    scale = _scaler(train, n)
    scaled = scale.transform(train).select("scaled", "label").persist()
    stages = {"scale": scale}
    for k in range(1, n_classes):
        step = scaled.where(F.col("label") >= k - 1).withColumn("label", (F.col("label") >= k).cast("double"))
        m = step.count()
        est = LogisticRegression(
            featuresCol="scaled", regParam=1.0 / (float(p.get("C", 1.0)) * max(m, 1)), elasticNetParam=0.0,
            standardization=False, maxIter=500, rawPredictionCol=f"_raw{k}", probabilityCol=f"_p{k}",
            predictionCol=f"_q{k}", family="binomial",
        )
        stages[f"step_{k}"] = PipelineModel([est.fit(step)])
    scaled.unpersist()
    return stages, {}


def fit_model(
    kind: str, train: DataFrame, params: dict, n_classes: int | None = None, val: DataFrame | None = None, seed: int = 0
) -> Fitted:
    """Fit one model. ``val`` is used for early stopping only."""
    head = train.select(F.size(vector_to_array("features")).alias("w")).first()
    if head is None:
        raise ValueError("no training rows")
    width, n = head["w"], train.count()
    if kind == "linreg":
        stages, meta = _linreg(train, params, n, width, seed)
    elif kind == "logreg":
        stages, meta = _logreg(train, params, n, width, seed)
    elif kind == "rf":
        stages, meta = _forest(RandomForestRegressor)(train, params, n, width, seed)
    elif kind == "rf_class":
        stages, meta = _forest(RandomForestClassifier)(train, params, n, width, seed)
    elif kind == "gbt":
        stages, meta = _boosted(train, params, seed, val)
    elif kind == "gbt_class":
        stages, meta = _boosted(train, params, seed, val, n_classes)
    elif kind == "mlp_class":
        stages, meta = _fit_mlp(train, params, n, width, seed, n_classes)
    elif kind == ORDINAL:
        stages, meta = _fit_ordinal(train, params, n, width, n_classes)
    else:
        raise ValueError(f"unknown model type {kind}")
    return Fitted(kind, stages, {**meta, "width": width, "n_classes": n_classes})


def dot(x: Column, w: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.lit([float(v) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _padded(proba: Column, n_classes: int) -> Column:
    """MLlib sizes the vector by the largest label seen in training; later classes get 0."""
    gap = F.lit(n_classes) - F.size(proba)
    return F.when(gap > 0, F.concat(proba, F.array_repeat(F.lit(0.0), gap))).otherwise(proba)


def _score(fitted: Fitted, rows: DataFrame) -> DataFrame:
    keep = rows.columns
    if fitted.kind == "log_contrast":
        x = vector_to_array("features")
        return rows.withColumn("prediction", dot(x, fitted.meta["coef"]) + F.lit(float(fitted.meta["intercept"])))
    k = fitted.meta.get("n_classes")
    if fitted.kind == ORDINAL:
        out = fitted.stages["scale"].transform(rows)
        for i in range(1, k):
            out = fitted.stages[f"step_{i}"].transform(out)
        logits = F.array(*[F.element_at(vector_to_array(f"_raw{i}"), 2) for i in range(1, k)])
        return out.select(*keep, corn_label(logits).cast("double").alias("prediction"), corn_proba(logits).alias("proba"))
    if "boosted" in fitted.meta:
        out = rows.withColumn("_m", margins(fitted.meta["boosted"], vector_to_array("features")))
        if k is None:
            return out.select(*keep, F.element_at("_m", 1).alias("prediction"))
        one = 1 / (1 + F.exp(-F.element_at("_m", 1)))
        proba = softmax(F.col("_m")) if fitted.meta["boosted"]["objective"] == "softmax" else F.slice(F.array(1 - one, one), 1, max(k, 1))
        out = out.withColumn("proba", proba)
        return out.select(*keep, argmax(F.col("proba")).cast("double").alias("prediction"), "proba")
    out = fitted.stages["main"].transform(rows)
    if fitted.kind in CLASSIFIERS:
        return out.select(*keep, "prediction", _padded(vector_to_array("probability"), k).alias("proba"))
    return out.select(*keep, "prediction")
