"""Sharding by a permutation-filled lookup table.

Each shard's name gives it an order of preference over the slots of a prime-sized table; shards take
turns to claim their next free slot until none is left. A row's key hashes to a slot and the table
names its shard, in constant time. Shards hold equal numbers of slots (to one), and adding or
removing a shard moves little more than its own share of the keys.

The table's size is a parameter (``SLOTS``, at most ``MAX_SLOTS``), independent of the data, so
broadcasting it is safe. Rows stay where they are: placing needs no shuffle.

Defined results: the slot of a null key is that of the hash of nothing; equal keys share a slot;
an empty table gives an empty one; the columns of the input stay, ``slot`` and ``shard`` replace
any of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """First slot and stride of the shard's walk through all slots."""
    digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not _is_prime(slots) or not len(shards) < slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime above the number of shards and at most {MAX_SLOTS}")
    owner = np.full(slots, -1, np.int32)
    walks = [preference(name, slots) for name in shards]
    at = [start for start, _ in walks]
    left = slots
    while left:
        for shard, (_, stride) in enumerate(walks):
            slot = at[shard]
            while owner[slot] >= 0:
                slot = (slot + stride) % slots
            owner[slot] = shard
            at[shard] = (slot + stride) % slots
            left -= 1
            if not left:
                break
    return owner


def place(df: DataFrame, shards: Sequence[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row."""
    owner = fill(shards, slots)
    names = np.array(shards, dtype=object)[owner]
    lookup = df.sparkSession.createDataFrame(pd.DataFrame({"_slot": np.arange(slots, dtype=np.int32), "_shard": names}))
    placed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(lookup), F.col("slot") == F.col("_slot"), "left").drop("_slot").withColumnRenamed("_shard", "shard")


def write(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder for each shard with about ``files_per_shard`` files."""
    part = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    n_shards = placed.select("shard").distinct().count()
    placed.repartition(max(1, n_shards * files_per_shard), "shard", part).write.partitionBy("shard").parquet(path)
