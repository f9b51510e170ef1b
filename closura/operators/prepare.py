"""Preparing the feature table: prefixing, alignment, zero removal, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.dataset import FEATURE_PREFIX, Dataset
from closura.session import materialize


def prefix_features(abund: DataFrame, prefix: str = FEATURE_PREFIX) -> DataFrame:
    """Always prepend ``prefix``, also to ids that already start with it."""
    return abund.withColumn("feature_id", F.concat(F.lit(prefix), F.col("feature_id").cast("string")))


def zero_features(abund: DataFrame) -> DataFrame:
    """The features whose total is exactly zero (what ``drop_zero_features`` removes)."""
    return (
        abund.groupBy("feature_id").agg(F.sum("value").alias("_total")).where("_total = 0").select("feature_id")
    )


def drop_zero_features(abund: DataFrame) -> DataFrame:
    """Keep the cells of features with a non-zero total.

    Only explicit zero cells (or cells that cancel) can make a feature vanish, so the
    removed set is the small side of an anti join.
    """
    return abund.join(zero_features(abund), "feature_id", "left_anti")


def sample_totals(abund: DataFrame) -> DataFrame:
    return abund.groupBy("sample_id").agg(F.sum("value").alias("total"))


def is_relative(abund: DataFrame) -> DataFrame:
    """One row: does every sample total round (3 digits) to 1?"""
    return sample_totals(abund).agg(F.bool_and(F.round("total", 3) == 1.0).alias("is_relative"))


def to_relative(abund: DataFrame, on_empty: str = "error", totals: DataFrame | None = None) -> DataFrame:
    """Divide by the sample total: a partial aggregate and an equi join, which AQE can
    broadcast or split; a window would sort every row."""
    if on_empty not in ("error", "drop"):
        raise ValueError("on_empty must be 'error' or 'drop'")
    totals = sample_totals(abund) if totals is None else totals
    if on_empty == "error":
        check = F.when(
            F.col("total") == 0, F.raise_error(F.concat(F.lit("sample without counts: "), F.col("sample_id")))
        ).otherwise(F.col("total"))
    else:
        totals, check = totals.where("total <> 0"), F.col("total")
    return abund.join(totals, "sample_id").withColumn("value", F.col("value") / check).drop("total")


def closed(abund: DataFrame, on_empty: str = "error") -> DataFrame:
    """All-or-nothing closure: if any sample is not yet a proportion, close them all.

    The totals are written once; the test and the division both read them."""
    totals = materialize(sample_totals(abund))
    if totals.agg(F.bool_and(F.round("total", 3) == 1.0)).first()[0]:
        return abund
    return to_relative(abund, on_empty, totals)


def prepare_features(abund: DataFrame, prefix: str = FEATURE_PREFIX, on_empty: str = "error") -> DataFrame:
    """Prefix, drop all-zero features, close; the result is sparse (non-zero cells only).

    The input is evaluated once. Where no cell is negative, a feature without a total has only zero
    cells, so dropping these cells drops it; an anti join is needed only if values can cancel."""
    cells = materialize(prefix_features(abund, prefix))
    totals = cells.groupBy("sample_id").agg(F.sum("value").alias("total"), F.bool_or(F.col("value") < 0).alias("negative"))
    totals = materialize(totals)
    negative, relative = totals.agg(F.bool_or("negative"), F.bool_and(F.round("total", 3) == 1.0)).first()
    if negative:
        return closed(drop_zero_features(cells), on_empty).where("value <> 0")
    out = cells if relative else to_relative(cells, on_empty, totals.drop("negative"))
    return out.where("value <> 0")


def common_sample_ids(samples: DataFrame, abund: DataFrame) -> DataFrame:
    return samples.select("sample_id").join(abund.select("sample_id").distinct(), "sample_id", "left_semi")


def align_samples(samples: DataFrame, abund: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restrict both tables to the samples they share."""
    return (
        samples.join(abund.select("sample_id").distinct(), "sample_id", "left_semi"),
        abund.join(samples.select("sample_id"), "sample_id", "left_semi"),
    )


def merge_metadata(samples: DataFrame, abund: DataFrame) -> DataFrame:
    """Metadata inner-joined with the cells."""
    return samples.join(abund, "sample_id")


def build_dataset(samples: DataFrame, abund: DataFrame) -> Dataset:
    """Align, prepare and bundle a table without history. The prepared cells are written because
    every later fit, transform and split starts from them."""
    samples, abund = align_samples(samples, abund)
    return Dataset.static(materialize(samples), materialize(prepare_features(abund)))
