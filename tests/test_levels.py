import pytest
from pyspark.sql import functions as F

from closura.operators import enrich, snapshot, stats
from closura.dataset import Dataset


def test_many_levels_are_numbered_in_order(spark):
    df = spark.range(60_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    got = stats.category_universe(df, ["a", "b"])
    assert got.groupBy("column").agg(F.count(F.lit(1)), F.max("pos")).orderBy("column").collect() == [("a", 60_000, 59_999), ("b", 1, 0)]
    assert got.where("column = 'a' AND category <> concat('v', lpad(cast(pos as string), 7, '0'))").count() == 0


def test_wide_things_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(enrich, "MAX_LEVELS", 3)
    monkeypatch.setattr(snapshot, "MAX_WIDE", 3)
    samples = spark.createDataFrame([(f"s{i}", f"c{i}") for i in range(5)], "sample_id string, c string")
    with pytest.raises(ValueError, match="levels"):
        enrich.category_levels(samples, ["c"])
    cells = spark.createDataFrame([("s1", f"f{i}", 1.0) for i in range(5)], "sample_id string, feature_id string, value double")
    with pytest.raises(ValueError, match="wide view"):
        snapshot.to_wide(Dataset.static(samples, cells))
