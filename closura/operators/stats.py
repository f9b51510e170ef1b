"""Per-feature and per-sample statistics over sparse cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.dataset import PSEUDOCOUNT
from closura.operators.ordered import ordered_prefix


def partial_moments(abund: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable moments of the non-zero cells: n1, total, mean, m2."""
    return (
        abund.groupBy(*keys)
        .agg(
            F.count("value").alias("n1"),
            F.sum("value").alias("total"),
            F.avg("value").alias("mean"),
            F.var_pop("value").alias("_vp"),
        )
        .withColumn("m2", F.col("_vp") * F.col("n1"))
        .drop("_vp")
    )


def merge_moments(parts: Column) -> Column:
    """Fold an array of (n1, total, mean, m2) structs into one by pairwise updating.
    The array holds one entry per fold, never one per row."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("n1"), F.lit(0.0).alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")
    )

    def step(a: Column, b: Column) -> Column:
        n = a["n1"] + b["n1"]
        delta = b["mean"] - a["mean"]
        return F.when(b["n1"] == 0, a).otherwise(
            F.struct(
                n.alias("n1"),
                (a["total"] + b["total"]).alias("total"),
                (a["mean"] + delta * b["n1"] / n).alias("mean"),
                (a["m2"] + b["m2"] + delta * delta * a["n1"] * b["n1"] / n).alias("m2"),
            )
        )

    return F.aggregate(parts, zero, step)


def variance_with_zeros(n_rows: Column) -> Column:
    """Sample variance over ``n_rows`` rows of which only n1 are stored."""
    n1, mean, m2 = F.col("n1"), F.col("mean"), F.col("m2")
    spread = m2 + mean * mean * n1 * (n_rows - n1) / n_rows
    return F.when(n_rows > 1, F.greatest(spread, F.lit(0.0)) / (n_rows - 1))


def feature_abundance(abund: DataFrame) -> DataFrame:
    return abund.groupBy("feature_id").agg(F.sum("value").alias("abundance"))


def feature_variance(abund: DataFrame, n_rows: int) -> DataFrame:
    return partial_moments(abund, ["feature_id"]).select(
        "feature_id", variance_with_zeros(F.lit(n_rows)).alias("variance")
    )


def feature_stats(abund: DataFrame, n_rows: int) -> DataFrame:
    """feature_id, n1, abundance, variance in one pass."""
    return partial_moments(abund, ["feature_id"]).select(
        "feature_id", "n1", F.col("total").alias("abundance"), variance_with_zeros(F.lit(n_rows)).alias("variance")
    )


def alr_denominator(abund: DataFrame, order: DataFrame) -> DataFrame:
    """The first (by ``pos``) feature with most non-zero cells; ``order`` maps feature_id to pos."""
    counts = abund.where("value <> 0").groupBy("feature_id").agg(F.count(F.lit(1)).alias("cnt"))
    best = (
        order.join(counts, "feature_id")
        .agg(F.max_by(F.struct("feature_id", "pos", "cnt"), F.struct("cnt", -F.col("pos"))).alias("d"))
        .select("d.*")
    )
    missing = F.when(F.col("pos").isNull(), F.raise_error(F.lit("no non-zero feature to serve as denominator")))
    return best.withColumn("pos", F.coalesce(missing.cast("int"), F.col("pos")))


def threshold_bounds(abund: DataFrame, measure: str, n_rows: int, features: DataFrame | None = None) -> DataFrame:
    """One row (lo, hi) of the per-feature measure; a zero lower bound becomes the pseudocount."""
    stats = feature_stats(abund, n_rows)
    if features is not None:
        stats = features.join(stats, "feature_id", "left").na.fill(0.0, ["abundance", "variance"])
    return bounds_of(stats, measure)


def bounds_of(stats: DataFrame, measure: str) -> DataFrame:
    """``threshold_bounds`` of statistics that are at hand."""
    return stats.agg(F.min(measure).alias("lo"), F.max(measure).alias("hi")).withColumn(
        "lo", F.when(F.col("lo") == 0, F.lit(PSEUDOCOUNT)).otherwise(F.col("lo"))
    )


def category_universe(samples: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct non-null values of each categorical column, with 0-based positions (column, pos, category).

    All columns are read in one pass; levels are numbered by chunked ranks, so a column may have any
    number of them and no row or task holds them all.
    """
    named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("category")) for c in cols])
    levels = samples.select(F.explode(named).alias("l")).select("l.*").where("category IS NOT NULL").distinct()
    ranked = ordered_prefix(levels, ["column"], [F.col("category")])
    return ranked.select("column", (F.col("rank") - 1).cast("int").alias("pos"), "category")


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of ``df`` for use in a plan; an error if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def label_index(samples: DataFrame, target: str) -> DataFrame:
    """Label dictionary: sorted distinct labels numbered from 0."""
    return category_universe(samples, [target]).select(F.col("category").alias("label"), F.col("pos").alias("idx"))


def encode_labels(samples: DataFrame, target: str, index: DataFrame, out: str = "y") -> DataFrame:
    lookup = index.select(F.col("label").alias("_label"), F.col("idx").cast("double").alias(out))
    return samples.join(lookup, F.col(target).cast("string") == F.col("_label"), "left").drop("_label")


def decode_labels(preds: DataFrame, index: DataFrame, code: str = "pred", out: str = "pred_label") -> DataFrame:
    lookup = index.select(F.col("label").alias(out), F.col("idx").alias("_idx"))
    return preds.join(lookup, F.col(code).cast("int") == F.col("_idx"), "left").drop("_idx")
