"""Fit and apply feature selection; every fit may carry leading keys (fold, snapshot)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.dataset import GROUP_FEATURES
from closura.operators.ordered import ordered_prefix
from closura.operators.stats import feature_stats
from closura.session import materialize

METHODS = tuple(f"{m}_{r}" for m in ("abundance", "variance") for r in ("ith", "topi", "quantile", "threshold"))


def measure_of(method: str) -> str:
    return method.split("_", 1)[0]


def group_feature(method: str | None) -> str | None:
    return GROUP_FEATURES[measure_of(method)] if method else None


def mark_low(
    stats: DataFrame,
    method: str,
    keys: list[str] | None = None,
    i: int | None = None,
    q: float | None = None,
    t: float | None = None,
) -> DataFrame:
    """Add ``is_low``: would the feature be grouped? ``stats`` has one row per (keys, feature)
    with columns abundance and variance. Ties are broken by feature_id ascending."""
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method}.")
    keys = keys or []
    measure, rule = method.split("_", 1)
    v = F.col(measure)
    if rule == "threshold":
        return stats.withColumn("is_low", v < F.lit(float(t)))
    if rule == "topi":
        ranked = ordered_prefix(stats, keys, [v.desc(), F.col("feature_id")])
        return ranked.withColumn("is_low", F.col("rank") > i).drop("rank", "n")
    ranked = ordered_prefix(stats, keys, [v.asc(), F.col("feature_id")], value=measure)
    if rule == "ith":
        # rank n-i+1 from below is the i-th largest; i beyond n means the smallest value
        at = F.greatest(F.col("n") - i + 1, F.lit(1))
        edge = ranked.groupBy(*keys).agg(
            F.max(F.when(F.col("rank") == at, v)).alias("_edge"),
            F.max("cum").alias("_all"),
        )
        low = (F.col("cum") <= F.col("_edge")) & (F.col("_all") > F.col("_edge"))
    else:
        h = F.lit(float(q)) * (F.col("n") - 1)
        lo = F.max(F.when(F.col("rank") == F.floor(h) + 1, v))
        hi = F.max(F.when(F.col("rank") == F.least(F.floor(h) + 2, F.col("n")), v))
        edge = ranked.groupBy(*keys).agg((lo + (hi - lo) * F.max(h - F.floor(h))).alias("_edge"))
        low = v < F.col("_edge")
    if keys:
        out = ranked.join(edge, keys)
    else:
        values = edge.first().asDict()  # one row of one or two numbers
        out = ranked.withColumns({name: F.lit(value).cast("double") for name, value in values.items()})
    return out.withColumn("is_low", low).drop("rank", "n", "cum", "_edge", "_all")


def freeze(marked: DataFrame, group_id: str | None, keys: list[str] | None = None) -> DataFrame:
    """Turn ``is_low`` marks into frozen params: (keys, pos, feature_id, is_group, n_selected).

    Fewer than two low features leave the table unchanged. Kept features are numbered
    by feature_id, the group comes last. One fit's rows are one design row wide.
    """
    keys = keys or []
    enough = F.sum(F.col("is_low").cast("int")) >= 2
    if keys:
        base = marked.select(*keys, "feature_id", "is_low").join(marked.groupBy(*keys).agg(enough.alias("_grouped")), keys)
    else:
        base = marked.select("feature_id", "is_low", F.lit(bool(marked.agg(enough).first()[0])).alias("_grouped"))
    collapsed = F.col("is_low") & F.col("_grouped")
    kept = base.where(~collapsed).select(*keys, "feature_id", F.lit(False).alias("is_group"))
    if group_id is not None:
        group = base.where(collapsed).select(*keys, F.lit(group_id).alias("feature_id"), F.lit(True).alias("is_group"))
        kept = kept.unionByName(group.distinct())
    # what is left of a fit is as long as a design row is wide
    per_fit = Window.partitionBy(*keys)
    order = per_fit.orderBy("is_group", "feature_id")
    return kept.select(
        *keys,
        (F.row_number().over(order) - 1).alias("pos"),
        "feature_id",
        "is_group",
        F.count(F.lit(1)).over(per_fit).alias("n_selected"),
    )


def clamp_i(i: int, n_features: int) -> int:
    if i > n_features:
        warnings.warn(f"i={i} exceeds the number of features; using {n_features}.")
        return n_features
    return i


def fit_selection(
    abund: DataFrame,
    method: str | None,
    n_rows: int,
    i: int | None = None,
    q: float | None = None,
    t: float | None = None,
    features: DataFrame | None = None,
) -> DataFrame:
    """Fit one selection and return the frozen features."""
    stats = feature_stats(abund, n_rows)
    if features is not None:
        stats = features.join(stats, "feature_id", "left").na.fill(0.0, ["abundance", "variance"]).na.fill(0, ["n1"])
    stats = materialize(stats)  # one row per feature, read several times below
    if method is None:
        return materialize(freeze(stats.withColumn("is_low", F.lit(False)), None))
    if method.endswith(("_ith", "_topi")):
        i = clamp_i(i, stats.count())
    frozen = materialize(freeze(mark_low(stats, method, i=i, q=q, t=t), group_feature(method)))
    if frozen.where("is_group").isEmpty():
        warnings.warn(f"No features found to group using method: {method}. Table stays unchanged.")
    return frozen


def low_features(abund: DataFrame, method: str, n_rows: int, **params) -> DataFrame:
    """The features a method would group."""
    return mark_low(feature_stats(abund, n_rows), method, **params).where("is_low").select("feature_id")


def collapse_low(abund: DataFrame, low: DataFrame, group_id: str) -> DataFrame:
    """Sum the cells of ``low`` features into ``group_id``, per sample."""
    flagged = abund.join(low.select("feature_id", F.lit(True).alias("_low")), "feature_id", "left")
    return (
        flagged.withColumn("feature_id", F.when(F.col("_low"), F.lit(group_id)).otherwise(F.col("feature_id")))
        .groupBy("sample_id", "feature_id")
        .agg(F.sum("value").alias("value"))
    )


def apply_selection(abund: DataFrame, frozen: DataFrame) -> DataFrame:
    """Reindex cells to the frozen features: unknown ones go to the group if the fit made one,
    else they are dropped. Sparse result (sample_id, pos, feature_id, value)."""
    group = frozen.where("is_group").select("pos", "feature_id").first()  # at most one row
    kept = frozen.where(~F.col("is_group")).select("feature_id", "pos")
    joined = abund.join(kept, "feature_id", "left")
    if group is None:
        joined = joined.where("pos is not null")
    else:
        fid = F.when(F.col("pos").isNull(), F.lit(group["feature_id"])).otherwise(F.col("feature_id"))
        joined = joined.withColumn("feature_id", fid).na.fill(group["pos"], ["pos"])
    return joined.groupBy("sample_id", "pos", "feature_id").agg(F.sum("value").alias("value"))
