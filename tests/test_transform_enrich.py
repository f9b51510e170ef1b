import numpy as np
import pytest
from pyspark.sql import functions as F

from closura.functions import rows
from closura.operators import enrich as enr
from helpers import cells, column

X = np.array([[10.0, 20.0], [20.0, 30.0], [50.0, 5.0]])
Z = np.array([[10.0, 20.0, 1.0], [20.0, 0.0, 4.0], [0.0, 5.0, 4.0]])


def run(spark, m, fn):
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(m)], "i int, x array<double>")
    return np.array([r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()])


def filled(m):
    return np.where(m == 0, 1e-9, m)


def clr_np(m):
    logs = np.log(filled(m))
    return logs - logs.mean(axis=1, keepdims=True)


@pytest.mark.parametrize("m", [X, Z])
def test_clr(spark, m):
    assert np.allclose(run(spark, m, lambda x: rows.clr(rows.pseudocount(x))), clr_np(m))


@pytest.mark.parametrize("m", [X, Z])
def test_ilr_is_the_gram_schmidt_basis(spark, m):
    n = m.shape[1]
    basis = np.array([[np.sqrt(1 / (i * (i + 1)))] * i + [-np.sqrt(i / (i + 1))] + [0] * (n - i - 1) for i in range(1, n)])
    got = run(spark, m, lambda x: rows.ilr(rows.pseudocount(x)))
    assert got.shape[1] == n - 1
    assert np.allclose(got, clr_np(m) @ basis.T)


def test_alr_is_a_plain_ratio(spark):
    assert np.allclose(run(spark, X, lambda x: rows.alr(x, 0)), X[:, 1:] / X[:, :1])
    got = run(spark, Z, lambda x: rows.alr_log(rows.pseudocount(x), 2))
    assert np.allclose(got, np.log(filled(Z)[:, :2] / Z[:, 2:]))


def test_presence_and_rank(spark):
    assert (run(spark, Z, rows.presence_absence) == (Z != 0)).all()
    assert run(spark, X, rows.rank_row).tolist() == [[2, 1], [2, 1], [1, 2]]
    assert run(spark, [[1, 3, 3, 0]], rows.rank_row).tolist() == [[3, 1.5, 1.5, 4]]


def test_dense_lays_out_gaps(spark):
    df = spark.createDataFrame([([(3, 1.5), (1, 2.0)],), ([],), (None,)], "e array<struct<pos:int,value:double>>")
    got = [r[0] for r in df.select(rows.dense(F.col("e"), F.lit(5))).collect()]
    assert got == [[0, 2.0, 0, 1.5, 0], [0] * 5, [0] * 5]


def test_softmax_argmax_corn(spark):
    m = np.array([[0.3, -1.0, 2.0], [1.0, 1.0, -3.0]])
    e = np.exp(m - m.max(axis=1, keepdims=True))
    assert np.allclose(run(spark, m, rows.softmax), e / e.sum(axis=1, keepdims=True))
    assert run(spark, m, rows.argmax).tolist() == [2, 0]
    cum = np.cumprod(1 / (1 + np.exp(-m)), axis=1)
    want = np.column_stack([1 - cum[:, 0], cum[:, 0] - cum[:, 1], cum[:, 1] - cum[:, 2], cum[:, 2]])
    assert np.allclose(run(spark, m, rows.corn_proba), want)
    assert run(spark, m, rows.corn_label).tolist() == (cum > 0.5).sum(axis=1).tolist()


def test_shannon_golden(spark):
    a = cells(spark, {"F0": [0.1, 0.0, 0.1], "F1": [0.2, 0.0, 0.1], "F2": [0.2, 0.6, 0.5], "F3": [0.5, 0.4, 0.3]})
    got = column(enr.shannon(a), "shannon_entropy")
    assert got["s1"] == pytest.approx(1.2206072605530174, abs=1e-12)
    assert got["s2"] == pytest.approx(0.6730116650092564, abs=1e-12)
    assert got["s3"] == pytest.approx(1.1682824461765626, abs=1e-12)


def test_one_hot_drop_first_and_universe(spark):
    df = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", None)], "sample_id string, md1 string")
    got = column(df.select("sample_id", rows.one_hot(F.col("md1"), ["a", "b", "c", "d"]).alias("v")), "v")
    assert got == {"s1": [0, 0, 0], "s2": [1, 0, 0], "s3": [0, 0, 0]}


def test_enrich_modes(spark):
    md = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 2), ("s3", "c", 3)], "sample_id string, md1 string, md2 int")
    a = cells(spark, {"F0": [1.0, 1.0, 0.5], "F1": [0.0, 0.0, 0.5]})
    names = lambda mode, cols=None: {r["name"] for r in enr.enrich(md, a, mode, cols).collect()}
    assert names("shannon") == {"shannon_entropy"}
    assert names("metadata_only", ["md1", "md2"]) == {"md1_b", "md1_c", "md2"}
    assert names("shannon_and_metadata", ["md1"]) == {"shannon_entropy", "md1_b", "md1_c"}
    assert names(None) == set()
    with pytest.raises(ValueError, match="not found"):
        enr.enrich(md, a, "metadata_only", ["nope"])
    with pytest.raises(ValueError, match="not implemented"):
        enr.enrich(md, a, "other")
