"""Summing cells along a lineage."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.functions.taxon import tax_label_with_parent
from closura.session import materialize

# Aggregation methods and their ranks.
AGGREGATIONS = {"tax_class": "class", "tax_order": "order", "tax_family": "family", "tax_genus": "genus"}


def align_taxonomy(tax: DataFrame, abund: DataFrame) -> DataFrame:
    """Lineages of the features present at t0; an error if there are none."""
    now = abund.where("t_off = 0") if "t_off" in abund.columns else abund
    kept = tax.join(now.select("feature_id").distinct(), "feature_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("no feature of the table has a taxonomy row")
    return kept


def unmatched_features(features: DataFrame, tax: DataFrame) -> DataFrame:
    """Features without a lineage: dropped by the aggregation."""
    return features.select("feature_id").distinct().join(tax.select("feature_id"), "feature_id", "left_anti")


def feature_labels(tax: DataFrame, rank: str) -> DataFrame:
    """feature_id -> label as a written table. One row per feature: its known file size, not a
    guess about the joins behind it, decides whether it is broadcast against the cells."""
    return materialize(tax.select("feature_id", tax_label_with_parent(F.col("taxon"), rank).alias("label")))


def aggregate_by_taxonomy(abund: DataFrame, tax: DataFrame, rank: str) -> DataFrame:
    """Cells summed per label; features without a lineage are dropped."""
    return aggregate_by_label(abund, feature_labels(tax, rank))


def aggregate_by_label(abund: DataFrame, labels: DataFrame) -> DataFrame:
    keys = [c for c in abund.columns if c not in ("feature_id", "value")]
    return (
        abund.join(labels, "feature_id")
        .groupBy(*keys, F.col("label").alias("feature_id"))
        .agg(F.sum("value").alias("value"))
    )


def labels_for(method: str | None, tax: DataFrame | None) -> DataFrame | None:
    """Dispatcher: None leaves the table as it is, ``tax_*`` sums along the lineage."""
    if method is None:
        return None
    if method not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {method!r}")
    return feature_labels(tax, AGGREGATIONS[method])


def aggregate_features(abund: DataFrame, method: str | None, tax: DataFrame | None) -> DataFrame:
    labels = labels_for(method, tax)
    return abund if labels is None else aggregate_by_label(abund, labels)


def aggregate_universe(features: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The column universe after aggregation; warns about features without a lineage."""
    if labels is None:
        return features.select("feature_id")
    lost = unmatched_features(features, labels).count()
    if lost:
        warnings.warn(f"{lost} features without a taxonomy row are left out")
    return features.join(labels, "feature_id").select(F.col("label").alias("feature_id")).distinct()
