import pytest
from pyspark.sql import types as T

from closura.sources import tables as io
from helpers import wide


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_metadata(spark, tmp_path):
    path = write(tmp_path, "md.tsv", "id\tage\tsite\n1\t3\tgut\n2\t4.5\tskin\n")
    df = io.read_metadata(spark, path)
    assert df.schema["sample_id"].dataType == T.StringType() and df.schema["age"].dataType == T.DoubleType()
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("age", T.DoubleType()), T.StructField("site", T.StringType())])
    assert io.read_metadata(spark, path, schema).columns == ["sample_id", "age", "site"]


def test_directive_rows_do_not_spoil_types(spark, tmp_path):
    path = write(tmp_path, "md.tsv", "sample-id\tage\tn\tsite\n#q2:types\tnumeric\tnumeric\tcategorical\ns1\t3.5\t1\tgut\ns2\t\t2\tskin\n")
    df = io.read_metadata(spark, path, directives=True)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "double", "bigint", "string"]
    assert {r["sample_id"]: r["age"] for r in df.collect()} == {"s1": 3.5, "s2": None}


def test_feature_tables_both_ways(spark, tmp_path):
    w = write(tmp_path, "w.tsv", "id\ta.1\tb\ns1\t1\t0\ns2\t0\t2.5\n")
    assert wide(io.read_features_wide(spark, w)) == {"a.1": {"s1": 1.0}, "b": {"s2": 2.5}}
    t = write(tmp_path, "t.tsv", "# Constructed from biom file\n#OTU ID\ts1\ts2\na.1\t1.0\t0.0\nb\t0.0\t2.5\n")
    assert wide(io.read_features_tall(spark, t)) == {"a.1": {"s1": 1.0}, "b": {"s2": 2.5}}


def test_ids_stay_text(spark, tmp_path):
    path = write(tmp_path, "md.tsv", "id\tage\n0012\t3\n7\t4\n")
    for directives in (False, True):
        df = io.read_metadata(spark, path, directives=directives)
        assert sorted(r["sample_id"] for r in df.collect()) == ["0012", "7"] and df.schema["age"].dataType == T.LongType()


def test_blank_cells_of_a_tall_table_are_zeros(spark, tmp_path):
    t = write(tmp_path, "t.tsv", "# comment\n#OTU ID\ts1\ts2\na\t\t2\nb\t1\t\n")
    assert wide(io.read_features_tall(spark, t)) == {"a": {"s2": 2.0}, "b": {"s1": 1.0}}


def test_taxonomy(spark, tmp_path):
    path = write(tmp_path, "tax.tsv", "Feature ID\tTaxon\tConfidence\nx1\td__A; p__B\t0.9\n")
    r = io.read_taxonomy(spark, path).first()
    assert (r["feature_id"], r["taxon"], r["confidence"]) == ("Fx1", "d__A; p__B", 0.9)
    unnamed = write(tmp_path, "tax2.tsv", "\tTaxon\tConfidence\nx1\td__A\t0.9\n")
    assert io.read_taxonomy(spark, unnamed).first()["feature_id"] == "Fx1"


def test_split_folders_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "sample_id string, split string")
    io.write_splits(df, str(tmp_path / "s"))
    got = io.read_split(spark, str(tmp_path / "s"), "train")
    assert [r["sample_id"] for r in got.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(split" in got._jdf.queryExecution().executedPlan().toString()


def test_metric_sink(spark, tmp_path):
    df = spark.createDataFrame([("m", 0.5)], "model string, rmse double")
    for fmt in ("csv", "parquet"):
        io.write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["rmse"] == "0.5"


def test_wide_files_of_a_hundred_thousand_columns(spark, tmp_path):
    """Far more columns than a plan could hold expressions."""
    n = 100_000
    lines = ["\t".join(["id", *[f'"f{j}"' for j in range(n)]])]
    lines += ["\t".join([f"s{i}", *["" if j % 7 == 0 else "1.5" if j % 50_000 == i else "0" for j in range(n)]]) for i in (1, 2)]
    (tmp_path / "wide.tsv").write_text("\n".join(lines) + "\n")
    got = sorted(tuple(r) for r in io.read_features_wide(spark, str(tmp_path / "wide.tsv")).collect())
    assert got == [("s1", "f1", 1.5), ("s2", "f2", 1.5), ("s2", "f50002", 1.5)]  # f50001 is blank


def test_wide_text_that_is_no_number_is_an_error(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("id\ta\ns1\tx\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        io.read_features_wide(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "empty.tsv").write_text("")
    assert io.read_features_wide(spark, str(tmp_path / "empty.tsv")).collect() == []
