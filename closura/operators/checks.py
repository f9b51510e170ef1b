"""Gates that stop a search before it starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.dataset import Dataset
from closura.operators.enrich import is_numeric
from closura.operators.snapshot import missing_rows

# Model types that accept missing values.
NULL_TOLERANT = ("rf", "rf_class", "gbt", "gbt_class")


def null_counts(samples: DataFrame, cols: list[str]) -> DataFrame:
    """One row: missing values per numeric column; categorical columns cannot be missing."""
    missing = [c for c in cols if c not in samples.columns]
    if missing:
        raise ValueError(f"Feature {missing} not found in the data.")
    numeric = [c for c in cols if is_numeric(samples, c)]
    counts = [
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in numeric
    ]
    return samples.agg(*counts) if counts else samples.agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")


def check_enrich_nulls(samples: DataFrame, cols: list[str], model_types: list[str]) -> None:
    """Error when a numeric enrichment column has gaps and a model cannot take them."""
    strict = [m for m in model_types if m not in NULL_TOLERANT]
    numeric = [c for c in cols if c not in samples.columns or is_numeric(samples, c)]
    if not strict or not numeric:
        return
    bad = {c: n for c, n in null_counts(samples, numeric).first().asDict().items() if n}
    if bad:
        raise ValueError(f"Columns {bad} have missing values, which {strict} cannot handle.")


def check_snapshot_nulls(ds: Dataset, model_types: list[str]) -> None:
    """Error when past snapshots are missing and a model cannot take NaN columns."""
    strict = [m for m in model_types if m not in NULL_TOLERANT]
    if not strict:
        return
    for k in ds.offsets[1:]:
        if not missing_rows(ds, k).isEmpty():
            raise ValueError(f"Missing past snapshots (t-{k}) cannot be handled by {strict}.")


def ordinal_levels(samples: DataFrame, target: str) -> DataFrame:
    """One row: number of distinct levels after half-even rounding, and missing targets."""
    return samples.agg(
        F.count_distinct(F.bround(F.col(target).cast("double"), 0)).alias("levels"),
        F.count_if(F.col(target).isNull() | F.isnan(F.col(target).cast("double"))).alias("missing"),
    )


def check_ordinal_levels(samples: DataFrame, target: str, cap: int) -> int:
    if isinstance(cap, bool) or not isinstance(cap, int) or cap < 2:
        raise ValueError("The cap on ordinal levels must be an integer of at least 2.")
    r = ordinal_levels(samples, target).first()
    if r["missing"]:
        raise ValueError(f"{r['missing']} targets are missing.")
    if r["levels"] > cap:
        raise ValueError(f"{r['levels']} ordinal levels exceed the cap of {cap}.")
    return r["levels"]
