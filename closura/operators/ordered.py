"""Ranks, prefix sums and cuts over a whole table without a single-task window.

``ordered_prefix`` range-partitions the rows on (keys, order), numbers the
resulting chunks, and adds per-chunk offsets to in-chunk windows, so a key that
holds most rows is spread over many chunks. ``hash_rank`` and ``hash_cut`` do the
same for the pseudo-random order of an md5 hash, whose chunks are known without
looking at the data and need no materialised table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closura.session import materialize

HASH_SHIFT = 20  # 32-bit hash -> 4096 buckets


def hash_order(seed: int, ident: Column) -> Column:
    """32 bits of md5(seed|id): the random order of every split and fold."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), ident.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def ordered_prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: str | None = None,
    rank: str = "rank",
    cum: str = "cum",
    total: str = "n",
) -> DataFrame:
    """Add the 1-based ``rank`` per keys, the row count ``total`` and, for ``value``,
    the inclusive prefix sum ``cum``. ``order`` must be a total order within keys;
    keys must be non-null."""
    keys = list(keys)
    chunk = keys + ["_chunk"]
    placed = materialize(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_chunk", F.spark_partition_id())
    )
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    if value:
        aggs.append(F.sum(value).alias("_sum"))
    totals = placed.groupBy(*chunk).agg(*aggs)
    # one row per (keys, chunk): at most #keys + #partitions rows
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        *chunk,
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(per_key).alias(total),
    ]
    if value:
        cols.append(F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_off_sum"))
    offsets = totals.select(*cols)
    within = Window.partitionBy(*chunk).orderBy(*order)
    out = placed.join(offsets, chunk).withColumn(rank, F.row_number().over(within) + F.col("_off"))
    if value:
        running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(cum, F.sum(value).over(running) + F.col("_off_sum"))
    return out.drop("_chunk", "_off", "_off_sum")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, tie: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles per keys from ranks: exact, and no task holds a whole group."""
    ranked = ordered_prefix(df.select(*keys, value, tie), keys, [F.col(value), F.col(tie)])
    aggs = []
    for name, q in quantiles.items():
        h = F.lit(float(q)) * (F.col("n") - 1)
        low = F.max(F.when(F.col("rank") == F.floor(h) + 1, F.col(value)))
        high = F.max(F.when(F.col("rank") == F.least(F.floor(h) + 2, F.col("n")), F.col(value)))
        frac = F.max(h - F.floor(h))
        aggs.append((low + (high - low) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def hash_rank(df: DataFrame, keys: Sequence[str], ident: str, seed: int) -> DataFrame:
    """Add ``rank`` (1-based, by hash then id) and ``n`` per keys."""
    keys = list(keys)
    bucketed = df.withColumn("_h", hash_order(seed, F.col(ident))).withColumn(
        "_b", F.shiftright(F.col("_h"), HASH_SHIFT)
    )
    per_key = Window.partitionBy(*keys)
    before = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(
            *keys,
            "_b",
            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
            F.sum("_cnt").over(per_key).alias("n"),
        )
    )
    within = Window.partitionBy(*keys, "_b").orderBy("_h", F.col(ident))
    return (
        bucketed.join(offsets, [*keys, "_b"])
        .withColumn("rank", F.row_number().over(within) + F.col("_off"))
        .drop("_h", "_b", "_off")
    )


def hash_cut(units: DataFrame, keys: Sequence[str], ident: str, seed: int, fraction: float) -> DataFrame:
    """Per keys, the hash and id of the floor(fraction * n)-th unit in hash order.

    A histogram of hash buckets finds the bucket that holds the cut; only that
    bucket's rows (about n / 4096) are sorted. Keys whose cut is 0 have no row.
    """
    keys = list(keys)
    units = units.select(*keys, F.col(ident).alias("_id"), hash_order(seed, F.col(ident)).alias("_h"))
    units = units.withColumn("_b", F.shiftright(F.col("_h"), HASH_SHIFT))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = (
        units.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        .select(
            *keys,
            "_b",
            (F.sum("_cnt").over(upto) - F.col("_cnt")).alias("_before"),
            F.sum("_cnt").over(upto).alias("_upto"),
            F.floor(F.lit(float(fraction)) * F.sum("_cnt").over(per_key) + F.lit(1e-9)).alias("_target"),
        )
        .where((F.col("_before") < F.col("_target")) & (F.col("_upto") >= F.col("_target")))
    )
    edge = Window.partitionBy(*keys, "_b").orderBy("_h", "_id")
    return (
        units.join(histogram, [*keys, "_b"])
        .withColumn("_r", F.row_number().over(edge) + F.col("_before"))
        .where(F.col("_r") == F.col("_target"))
        .select(*keys, F.col("_h").alias("cut_hash"), F.col("_id").alias("cut_id"))
    )
