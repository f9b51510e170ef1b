"""What the fourth round's findings asked for."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from closura.dataset import Dataset
from closura.functions import rows as fr
from closura.models import log_contrast as lc
from closura.operators import tree as tr
from closura.plans import search as se
from closura.sources import tables as io
from helpers import wide

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def test_header_is_the_line_that_stands_first_whichever_file_is_read_first(spark, tmp_path):
    """Spark reads the largest part of a table first; its first line is not the header."""
    (tmp_path / "part-00000").write_text("# Constructed from a table\n#OTU ID\t7\t8\n")
    (tmp_path / "part-00001").write_text("".join(f"f{i}\t{i}.0\t{i + 1}.0\n" for i in range(50)))
    got = wide(io.read_features_tall(spark, str(tmp_path)))
    assert got == {f"f{i}": {s: float(v) for s, v in (("7", i), ("8", i + 1)) if v} for i in range(50)}


def test_ordinal_learns_the_labels_of_the_table(spark, tmp_path):
    """Three levels that the last component tells; the most frequent one stands in half of the rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.125, (800, 64)).astype("float32")
    y = (x[:, -1] > 0).astype(int) + (x[:, -1] > 0.1)
    spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(800)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r[c] for c in ("held", "n", "base", "better")) for r in QUERIES["M12_ordinal"](spark, str(tmp_path)).collect()}
    held = np.arange(800) % 5 == 0
    assert got == {(h, int((held == h).sum()), float((y[held == h] == 0).sum()), True) for h in (False, True)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["M12_ordinal"]).fetchall())


@pytest.mark.parametrize("block, lam", [(64, 0.01), (20, 0.3)])
def test_log_contrast_lays_out_no_row(spark, block, lam):
    """Rows of the cells that differ from the constant give what full rows give, by sums and by columns in use."""
    rng = np.random.default_rng(9)
    tips = [(f"F{j}", f"n{j % 3}", True, j) for j in range(30)] + [(f"n{k}", "root", False, k) for k in range(3)]
    matrix = tr.tip_ancestors(spark.createDataFrame(tips, "node string, parent string, is_tip boolean, ord long"))
    tree = se.Tree(matrix, tr.matrix_columns(matrix))
    some = [(f"s{i}", f"F{j}", float(rng.uniform(0.01, 1))) for i in range(200) for j in rng.choice(30, 1 + i % 4, replace=False)]
    y = {f"s{i}": float(rng.normal()) for i in range(201)}  # the last sample has no cell
    for s, f, v in some:
        y[s] += 2.0 * (f in ("F3", "F7")) - 1.5 * (f == "F4")
    samples = spark.createDataFrame(list(y.items()), "sample_id string, y double")
    ds = Dataset.static(samples, spark.createDataFrame(some, "sample_id string, feature_id string, value double"))
    rows = se.contrast_rows(ds, tree, "y")
    sizes = {r["sample_id"]: len(r["pos"]) for r in rows.collect()}
    assert len(sizes) == 201 and sizes["s200"] == 0 and max(sizes.values()) <= 7
    full = tr.log_geom(ds.samples, ds.abund, tree.matrix, tree.columns).join(samples, "sample_id")
    got, want = (lc.fit_log_contrast(r, tree.n_leaves(), lam, block=block) for r in (rows, full))
    assert np.abs(want.meta["coef"]).max() > 0.01
    for part, off in (("norefit", 1e-7), ("coef", 1e-6), ("intercept", 1e-5)):
        assert got.meta[part] == pytest.approx(want.meta[part], abs=off)
    tm = se.TunedModel(got, None, None, None, None, tree)
    seen = {r["sample_id"]: r["pred"] for r in tm.predict(ds).collect()}
    assert seen == pytest.approx({r["sample_id"]: r["pred"] for r in tm.predict_design(tm.design(ds)).collect()}, abs=1e-9)


@pytest.mark.parametrize("size", [150, 128_000])
def test_tall_table_is_read_cell_by_cell(spark, tmp_path, size):
    """Blocks that cut lines and cells anywhere; no read hands over a line. Blank cells, quotes, text, short and long lines,
    comments between lines, repeated headers, numbers as names."""
    rng = np.random.default_rng(5)
    names = [str(100 + j) for j in range(40)]
    table = {f"f{i}": [float(v) if v > 2 else 0.0 for v in rng.integers(0, 9, 40)] for i in range(12)}
    head = "#OTU ID\t" + "\t".join(names)
    lines = ["# Constructed from a table", "", head]
    for i, (f, vs) in enumerate(table.items()):
        lines.append(f + "\t" + "\t".join('"%s"' % v if v == 3 else "" if v == 0 and i % 2 else str(v) for v in vs))
        lines += {3: ["# a comment", "no tab here"], 5: [head], 7: ["#OTU ID\tx\t1.0"]}.get(i, [])
    lines += ["short\t1.0", "long\t" + "\t".join(["0.0"] * 45 + ["7.0"])]
    (tmp_path / "part-00000").write_text("\n".join(lines[:9]) + "\n")
    (tmp_path / "part-00001").write_text("\r\n".join(lines[9:]))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = io.read_features_tall(spark, str(tmp_path))
        assert "split(" not in got._jdf.queryExecution().toString()
        rows = {(r["feature_id"], r["sample_id"]): r["value"] for r in got.collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(f, s): v for f, vs in table.items() for s, v in zip(names, vs) if v} | {("short", "100"): 1.0, ("#OTU ID", "101"): 1.0}
    assert rows == want


def test_rounding_without_decimals_is_as_duckdb_rounds(spark):
    """To the last bit, and without a negative zero."""
    rng = np.random.default_rng(7)
    some = [*rng.normal(size=2000) * 10.0 ** rng.integers(-12, 9, 2000), 0.0, -0.0, -1e-12, 5e-10, 2.5e-9, float("nan"), float("inf"), 1e300, None]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(some)], "i int, v double")
    got = [r["r"] for r in df.select("i", fr.rounded(F.col("v"), 9).alias("r")).orderBy("i").collect()]
    con = duckdb.connect()
    for v, g in zip(some, got):
        if v is None:
            assert g is None
        elif abs(v) < 1e6:
            assert str(g) == str(con.execute("SELECT round(?::DOUBLE, 9) + 0.0::DOUBLE", [float(v)]).fetchone()[0])
        else:  # also what is no number
            assert g == pytest.approx(v, rel=1e-14, nan_ok=True)
