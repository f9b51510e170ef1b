"""From raw tables to a split dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from closura.dataset import Dataset
from closura.operators.prepare import align_samples, build_dataset, prepare_features
from closura.operators.snapshot import snapshot_windows
from closura.operators.splits import split
from closura.session import materialize


def split_train_test(
    samples: DataFrame,
    abund: DataFrame,
    train_size: float,
    seed: int,
    group: str | None = None,
    stratify: list[str] | None = None,
    host: str | None = None,
    time: str | None = None,
    n_prev: int | None = None,
    missing_mode: str = "exclude",
    order_col: str | None = None,
) -> tuple[Dataset, DataFrame]:
    """Align, prepare, optionally window, and split: (dataset, (sample_id, split))."""
    temporal = (host, time, n_prev)
    if any(v is not None for v in temporal):
        if any(v is None for v in temporal):
            raise ValueError("host, time and n_prev must be given together.")
        samples, abund = align_samples(samples, abund)
        cells = materialize(prepare_features(abund))
        ds = snapshot_windows(samples, cells, host, time, n_prev, missing_mode, order_col)
    else:
        ds = build_dataset(samples, abund)
    now = ds.samples.where("t_off = 0")
    return ds, split(now, train_size, seed, group, stratify).select("sample_id", "split")
