"""Columns added next to the features: diversity and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from closura.dataset import PSEUDOCOUNT
from closura.functions.rows import one_hot
from closura.operators.stats import bounded_rows, category_universe

# Enrichment modes.
MODES = (None, "shannon", "shannon_and_metadata", "metadata_only")
SHANNON = "shannon_entropy"
MAX_LEVELS = 100_000  # columns that one-hot coding may add


def shannon_term(value: Column) -> Column:
    return -value * F.log(value + F.lit(PSEUDOCOUNT))


def shannon(abund: DataFrame) -> DataFrame:
    """Entropy per sample; zero cells add nothing, so the stored ones suffice."""
    return abund.groupBy("sample_id").agg(F.sum(shannon_term(F.col("value"))).alias(SHANNON))


def is_numeric(samples: DataFrame, col: str) -> bool:
    return isinstance(samples.schema[col].dataType, NumericType)


def uses_shannon(mode: str | None) -> bool:
    return mode in ("shannon", "shannon_and_metadata")


def metadata_columns(mode: str | None, cols: list[str] | None) -> list[str]:
    if mode not in MODES:
        raise ValueError(f"Enrichment {mode} is not implemented.")
    return list(cols or []) if mode in ("shannon_and_metadata", "metadata_only") else []


def category_levels(samples: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted level lists of the categorical columns among ``cols`` (design-width sized)."""
    missing = [c for c in cols if c not in samples.columns]
    if missing:
        raise ValueError(f"Feature {missing} not found in the data.")
    cats = [c for c in cols if not is_numeric(samples, c)]
    if not cats:
        return {}
    levels: dict[str, list[str]] = {c: [] for c in cats}
    for r in bounded_rows(category_universe(samples, cats).orderBy("column", "pos"), MAX_LEVELS, "levels: each would be a column of the design"):
        levels[r["column"]].append(r["category"])
    return levels


def metadata_block(samples: DataFrame, cols: list[str], levels: dict[str, list[str]]) -> Column:
    """The enrichment columns of one row as array<double>; numeric NULL becomes NaN."""
    parts = [
        one_hot(F.col(c), levels[c]) if c in levels else F.array(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
        for c in cols
    ]
    return F.concat(*parts) if parts else F.array().cast("array<double>")


def metadata_names(cols: list[str], levels: dict[str, list[str]]) -> list[str]:
    names: list[str] = []
    for c in cols:
        names += [f"{c}_{v}" for v in levels[c][1:]] if c in levels else [c]
    return names


def enrich(samples: DataFrame, abund: DataFrame, mode: str | None, cols: list[str] | None = None) -> DataFrame:
    """sample_id, name, value: the enrichment columns in long form."""
    md = metadata_columns(mode, cols)
    levels = category_levels(samples, md)
    names = ([SHANNON] if uses_shannon(mode) else []) + metadata_names(md, levels)
    frame = samples.select("sample_id", metadata_block(samples, md, levels).alias("x"))
    if uses_shannon(mode):
        frame = frame.join(shannon(abund), "sample_id", "left").withColumn(
            "x", F.concat(F.array(F.coalesce(SHANNON, F.lit(0.0))), "x")
        )
    if not names:
        return frame.select("sample_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value")).limit(0)
    labels = F.array(*[F.lit(n) for n in names])
    return frame.select("sample_id", F.posexplode("x").alias("p", "value")).select(
        "sample_id", F.element_at(labels, F.col("p") + 1).alias("name"), "value"
    )
