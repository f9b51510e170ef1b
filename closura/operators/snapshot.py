"""Per-host windows of contiguous past samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from closura.dataset import Dataset, suffixed, time_label_col
from closura.operators.stats import bounded_rows
from closura.session import materialize

MAX_WIDE = 20_000  # columns of a wide view


def checked_time(samples: DataFrame, time: str):
    """The time column truncated to an integer; non-numeric values are an error."""
    value = F.expr(f"try_cast(`{time}` as double)")
    bad = F.raise_error(F.concat(F.lit("Non-numeric time: "), F.coalesce(F.col(time).cast("string"), F.lit("NULL"))))
    return F.when(value.isNull() | F.isnan(value), bad.cast("int")).otherwise(value.cast("int"))


def last_per_time(samples: DataFrame, host: str, time: str, order_col: str | None = None) -> DataFrame:
    """(host, time, sample_id): the last sample of each host and time by ``order_col``, then id.

    A maximum of structs combines on the map side, so a host and time with very many
    samples never gathers in one task."""
    order = F.struct(*([F.col(order_col)] if order_col else []), F.col("sample_id"))
    return (
        samples.select(F.col(host).alias("_host"), checked_time(samples, time).alias("_time"), order.alias("_o"))
        .groupBy("_host", "_time")
        .agg(F.max("_o").alias("_o"))
        .select(F.col("_host").alias(host), F.col("_time").alias(time), F.col("_o.sample_id").alias("sample_id"))
    )


def window_links(
    samples: DataFrame, host: str, time: str, n_prev: int, missing_mode: str = "exclude", order_col: str | None = None
) -> DataFrame:
    """(sample_id, t_off, host, time, source_id): which sample fills each slot of each window.

    Every sample offers itself to the windows starting 0..n_prev steps later; one grouping by
    (host, start) then collects a window, which has at most n_prev + 1 rows."""
    if missing_mode not in ("exclude", "nan"):
        raise ValueError("missing_mode is 'exclude' or 'nan'")
    if n_prev < 0:
        raise ValueError("n_prev must not be negative")
    last = last_per_time(samples, host, time, order_col)
    steps = range(n_prev + 1)
    offered = last.select(
        F.col(host).alias("_host"), F.col(time).alias("_time"), F.col("sample_id").alias("_src"),
        F.explode(F.array(*[F.lit(k) for k in steps])).alias("_k"),
    )
    windows = (
        offered.groupBy("_host", (F.col("_time") + F.col("_k")).alias("_t0"))
        .agg(*[F.max(F.when(F.col("_k") == k, F.col("_src"))).alias(f"_s{k}") for k in steps])
        .where("_s0 is not null")
    )
    if missing_mode == "exclude":
        for k in steps:
            windows = windows.where(F.col(f"_s{k}").isNotNull())
    slots = F.array(*[F.struct(F.lit(k).alias("t_off"), F.col(f"_s{k}").alias("source_id")) for k in steps])
    return windows.select("_host", "_t0", F.col("_s0").alias("sample_id"), F.explode(slots).alias("_w")).select(
        "sample_id", "_w.t_off", F.col("_host").alias(host), (F.col("_t0") - F.col("_w.t_off")).alias(time), "_w.source_id"
    )


def snapshot_windows(
    samples: DataFrame,
    abund: DataFrame,
    host: str,
    time: str,
    n_prev: int,
    missing_mode: str = "exclude",
    order_col: str | None = None,
) -> Dataset:
    """Windows over prepared cells. Missing past slots (mode ``nan``) keep host and the computed
    time, other metadata NULL, and have no cells."""
    links = materialize(window_links(samples, host, time, n_prev, missing_mode, order_col))
    if missing_mode == "exclude" and links.isEmpty():
        raise ValueError("no sample has a whole window of earlier times; ask for less history or missing_mode='nan'")
    rest = [c for c in samples.columns if c not in ("sample_id", host, time)]
    time_type = samples.schema[time].dataType
    if not isinstance(time_type, NumericType):
        time_type = "int"
    source = samples.select(F.col("sample_id").alias("source_id"), F.col(time).cast(time_type).alias("_own_time"), *rest)
    md = links.join(source, "source_id", "left").select(
        "sample_id", host, F.coalesce("_own_time", F.col(time).cast(time_type)).alias(time), *rest,
        "t_off", F.col("source_id").isNotNull().alias("present"),
    )
    cells = links.select("sample_id", "t_off", "source_id").join(
        abund.select(F.col("sample_id").alias("source_id"), "feature_id", "value"), "source_id"
    )
    return Dataset(
        samples=md.select("sample_id", *[c for c in samples.columns if c != "sample_id"], "t_off", "present"),
        abund=cells.select("sample_id", "t_off", "feature_id", "value"),
        features=abund.select("feature_id").distinct(),
        n_prev=n_prev,
    )


def snapshot(ds: Dataset, k: int) -> Dataset:
    """One snapshot as a table of its own."""
    return ds.with_(samples=ds.samples.where(F.col("t_off") == k), abund=ds.abund.where(F.col("t_off") == k))


def time_labels(abund: DataFrame) -> DataFrame:
    """Labels present, t0 first."""
    return abund.select("t_off").distinct().select("t_off", time_label_col(F.col("t_off")).alias("label")).orderBy("t_off")


def missing_rows(ds: Dataset, k: int) -> DataFrame:
    """Samples none of whose features is observed at offset ``k``."""
    seen = ds.abund.where(F.col("t_off") == k).select("sample_id").distinct()
    return ds.samples.where(F.col("t_off") == k).select("sample_id").join(seen, "sample_id", "left_anti")


def restore_missing(block: DataFrame, ds: Dataset, k: int) -> DataFrame:
    """Engineered rows of one snapshot with the missing observations back as NULL rows."""
    lost = missing_rows(ds, k)
    for c in block.columns:
        if c != "sample_id":
            lost = lost.withColumn(c, F.lit(None).cast(block.schema[c].dataType))
    return block.unionByName(lost)


def _require_same(a: DataFrame, b: DataFrame, what: str) -> None:
    for left, right in ((a, b), (b, a)):
        if not left.join(right, a.columns, "left_anti").isEmpty():
            raise ValueError(f"Snapshots differ in their {what}.")


def merge_snapshots(parts: list[tuple[DataFrame, DataFrame]], features: list[DataFrame] | None = None) -> Dataset:
    """Stack (samples, abund) of t0, t-1, ... after checking that they describe the same
    samples (and, when given, the same features)."""
    if not parts:
        raise ValueError("No snapshots given.")
    ids = parts[0][0].select("sample_id")
    for s, _ in parts[1:]:
        _require_same(ids, s.select("sample_id"), "sample ids")
    for f in (features or [])[1:]:
        _require_same(features[0].select("feature_id"), f.select("feature_id"), "features")
    samples = abund = None
    for k, (s, a) in enumerate(parts):
        s = s.drop("t_off").withColumn("t_off", F.lit(k))
        s = s if "present" in s.columns else s.withColumn("present", F.lit(True))
        a = a.drop("t_off").withColumn("t_off", F.lit(k))
        samples = s if samples is None else samples.unionByName(s)
        abund = a if abund is None else abund.unionByName(a)
    universe = features[0].select("feature_id") if features else abund.select("feature_id").distinct()
    return Dataset(samples, abund, universe, len(parts) - 1)


def to_wide(ds: Dataset, metadata: list[str] | None = None) -> DataFrame:
    """One row per sample with suffixed columns; the explicit column list is the table's width, which is bounded."""
    feats = [r[0] for r in bounded_rows(ds.features.orderBy("feature_id"), MAX_WIDE // len(ds.offsets), "features for a wide view; keep the long form")]
    md = metadata if metadata is not None else [c for c in ds.samples.columns if c not in ("sample_id", "t_off", "present")]
    names = {o: [suffixed(f, o) for f in feats] for o in ds.offsets}
    label = F.col("feature_id")
    for o in ds.offsets[1:]:
        label = F.when(F.col("t_off") == o, F.concat("feature_id", F.lit(suffixed("", o)))).otherwise(label)
    cells = (
        ds.abund.select("sample_id", label.alias("label"), "value")
        .groupBy("sample_id")
        .pivot("label", [n for o in ds.offsets for n in names[o]])
        .agg(F.first("value"))
    )
    aggs = [F.max(F.when(F.col("t_off") == o, F.col("present"))).alias(f"_here{o}") for o in ds.offsets]
    aggs += [F.max(F.when(F.col("t_off") == o, F.col(c))).alias(suffixed(c, o)) for o in ds.offsets for c in md]
    wide = ds.samples.groupBy("sample_id").agg(*aggs).join(cells, "sample_id", "left")
    values = [
        F.when(F.col(f"_here{o}"), F.coalesce(F.col(f"`{n}`"), F.lit(0.0))).alias(n) for o in ds.offsets for n in names[o]
    ]
    return wide.select("sample_id", *[suffixed(c, o) for o in ds.offsets for c in md], *values)
