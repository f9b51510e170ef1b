"""Session defaults and the two ways a frame is pinned between jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "closura", cpus: str | int = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CLOSURA_DRIVER_MEMORY", "8g"))
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder all executors share")
        if app not in _local_scratch:
            _local_scratch[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        path = _local_scratch[app]
    return path


def release(*frames: DataFrame) -> None:
    """Delete the tables that ``materialize`` wrote for ``frames``; none may be read afterwards."""
    for df in frames:
        path = getattr(df, "_closura_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``release`` deletes it.

    Cuts the lineage, survives the loss of executors, and gives the next plan
    file statistics, so join strategies rest on a known size. It also pins
    values that a recomputation could change (chunk numbers after range
    partitioning).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/closura-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._closura_path = path
    return out
