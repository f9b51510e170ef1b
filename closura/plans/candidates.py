"""The table of trials to run: one row per trial, every setting a hash of (seed, trial, setting).

Ranges are plain tuples: ("float", lo, hi, log), ("int", lo, hi), ("choice", [values]).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.operators.ordered import hash_order
from closura.operators.select import METHODS
from closura.operators.taxonomy import AGGREGATIONS

# Default ranges of the model settings.
_FOREST = {
    "n_estimators": ("int", 20, 3000),
    "max_depth": ("choice", [2, 4, 8, 16, 30]),  # what MLlib can grow
    "min_samples_split": ("float", 1e-3, 0.1, True),
    "min_weight_fraction_leaf": ("float", 0.0, 0.01, False),
    "min_samples_leaf": ("float", 1e-3, 0.1, True),
    "max_features": ("choice", [None, "sqrt", "log2", "0.1", "0.2", "0.3", "0.5"]),
    "min_impurity_decrease": ("float", 0.0, 0.5, False),
    "bootstrap": ("choice", [True, False]),
}
_BOOSTED = {
    "n_estimators": ("int", 20, 3000),
    "max_depth": ("int", 2, 10),
    "subsample": ("float", 0.7, 1.0, False),
    "eta": ("float", 0.01, 0.3, True),
    "gamma": ("float", 1e-3, 5.0, True),
    "colsample": ("float", 0.3, 1.0, False),
    "min_child_weight": ("int", 0, 4),
    "num_parallel_tree": ("int", 1, 4),
    "reg_alpha": ("float", 1e-10, 1.0, True),
    "reg_lambda": ("float", 1e-10, 1.0, True),
}
SPACES: dict[str, dict[str, tuple]] = {
    "linreg": {"alpha": ("float", 1e-5, 100.0, True), "l1_ratio": ("float", 0.0, 1.0, False)},
    "logreg": {
        "C": ("float", 1e-4, 1e4, True),
        "penalty": ("choice", ["l1", "l2", "elasticnet"]),
        "l1_ratio": ("float", 0.0, 1.0, False),
    },
    "rf": _FOREST,
    "rf_class": _FOREST,
    "gbt": _BOOSTED,
    "gbt_class": _BOOSTED,
    "mlp_class": {
        "n_hidden_layers": ("int", 1, 30),
        "width": ("choice", [32, 64, 128, 256, 512]),
        "batch_size": ("choice", [32, 64, 128, 256]),
        "epochs": ("choice", [10, 50, 100, 200]),
    },
    "ordinal": {"C": ("float", 1e-4, 1e4, True)},
    "log_contrast": {"lambda": ("float", 1e-3, 1.0, True)},
}
DATA_COLUMNS = ("aggregation", "selection", "i", "q", "t", "transform", "enrich")


def uniform(seed: int, name: str) -> Column:
    """A number in (0, 1) from the trial id and the setting's name."""
    return (hash_order(seed, F.concat(F.col("trial").cast("string"), F.lit(f"|{name}"))) + F.lit(0.5)) / F.lit(float(2**32))


def _number(u: Column, lo: float, hi: float, log: bool) -> Column:
    if log:
        return F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi) - math.log(lo)))
    return F.lit(float(lo)) + u * F.lit(float(hi) - float(lo))


def draw(spec: tuple, seed: int, name: str) -> Column:
    u = uniform(seed, name)
    if spec[0] == "choice":
        return F.element_at(F.array(*[F.lit(v) for v in spec[1]]), (F.floor(u * len(spec[1])) + 1).cast("int"))
    if spec[0] == "int":
        return (F.lit(spec[1]) + F.floor(u * (spec[2] - spec[1] + 1))).cast("int")
    return _number(u, spec[1], spec[2], bool(spec[3]))


def candidates(
    model_type: str,
    trials: DataFrame,
    seed: int,
    n_features: int,
    bounds: dict[str, tuple[float, float]],
    overrides: dict | None = None,
    has_taxonomy: bool = False,
    enrich_with: tuple[str, ...] = (),
) -> DataFrame:
    """Add the settings to ``trials`` (column ``trial``). ``bounds`` holds (lo, hi) of the per-feature
    abundance and variance. Settings that do not apply to a trial are NULL."""
    if model_type not in SPACES:
        raise ValueError(f"unknown model type {model_type!r}")
    o = dict(overrides or {})
    space = {**SPACES[model_type], **{k: v for k, v in o.items() if k in SPACES[model_type]}}
    out = trials.select("trial").withColumn("model_type", F.lit(model_type))
    text = lambda: F.lit(None).cast("string")
    if model_type == "log_contrast":
        out = out.withColumns({c: text() if c not in ("i", "q", "t") else F.lit(None).cast("int" if c == "i" else "double") for c in DATA_COLUMNS})
    else:
        agg = o.get("aggregation", ("choice", [None, *AGGREGATIONS] if has_taxonomy else [None]))
        sel = o.get("selection", ("choice", [None, *METHODS]))
        modes = [None, "shannon", "shannon_and_metadata", "metadata_only"] if enrich_with else [None, "shannon"]
        out = out.withColumns({
            "aggregation": draw(agg, seed, "aggregation").cast("string"),
            "selection": draw(sel, seed, "selection").cast("string"),
        })
        s = F.col("selection")
        i = draw(o.get("i", ("int", 1, n_features)), seed, "i")
        q = draw(o.get("q", ("float", 0.5, 0.9, False)), seed, "q")
        by = {m: draw(o.get("t", ("float", *bounds[m], True)), seed, "t") for m in ("abundance", "variance")}
        out = out.withColumns({
            "i": F.when(s.endswith("_ith") | s.endswith("_topi"), i),
            "q": F.when(s.endswith("_quantile"), q),
            "t": F.when(s == "abundance_threshold", by["abundance"]).when(s == "variance_threshold", by["variance"]),
            "transform": draw(o.get("transform", ("choice", [None, "clr", "ilr", "alr", "pa", "rank"])), seed, "transform").cast("string"),
            "enrich": draw(o.get("enrich", ("choice", modes)), seed, "enrich").cast("string"),
        })
    out = out.withColumns({name: draw(spec, seed, name) for name, spec in space.items()})
    if model_type == "logreg":
        out = out.withColumn("l1_ratio", F.when(F.col("penalty") == "elasticnet", F.col("l1_ratio")))
    return out


def with_start_points(table: DataFrame, points: list[dict]) -> DataFrame:
    """Put given settings in front: each point replaces the drawn values of one trial, in trial order."""
    if not points:
        return table
    first = [r["trial"] for r in table.select("trial").orderBy("trial").limit(len(points)).collect()]
    for trial, point in zip(first, points):
        mine = F.col("trial") == F.lit(trial)
        table = table.withColumns({
            k: F.when(mine, F.lit(v).cast(table.schema[k].dataType)).otherwise(F.col(f"`{k}`")) for k, v in point.items()
        })
    return table
