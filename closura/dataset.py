"""The long, sparse data model shared by all operators.

samples   one row per sample (and snapshot): ``sample_id``, metadata columns;
          after windowing also ``t_off`` (0 = t0, 1 = one step back) and ``present``
abund     non-zero cells: ``sample_id``, ``feature_id``, ``value`` (``t_off`` after windowing)
features  the column universe: ``feature_id``
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pseudocount, feature prefix, stratum separator, names of grouped features.
PSEUDOCOUNT = 1e-9
FEATURE_PREFIX = "F"
STRATUM_SEPARATOR = "__§__"
GROUP_FEATURES = {"abundance": "F_low_abun", "variance": "F_low_var"}


@dataclass(frozen=True)
class Dataset:
    samples: DataFrame
    abund: DataFrame
    features: DataFrame
    n_prev: int = 0

    @staticmethod
    def static(samples: DataFrame, abund: DataFrame) -> "Dataset":
        """A dataset without history: every row is t0 and present."""
        return Dataset(
            samples=samples.withColumns({"t_off": F.lit(0), "present": F.lit(True)}),
            abund=abund.withColumn("t_off", F.lit(0)),
            features=abund.select("feature_id").distinct(),
        )

    def with_(self, **changes) -> "Dataset":
        return replace(self, **changes)

    @property
    def offsets(self) -> list[int]:
        return list(range(self.n_prev + 1))


def time_label(t_off: int) -> str:
    return "t0" if t_off == 0 else f"t-{t_off}"


def time_label_col(t_off: Column) -> Column:
    return F.when(t_off == 0, F.lit("t0")).otherwise(F.concat(F.lit("t-"), t_off.cast("string")))


def suffixed(name: str, t_off: int) -> str:
    return name if t_off == 0 else f"{name}__{time_label(t_off)}"
