import time
import numpy as np
import pytest
from pyspark.sql import functions as F

from closura.functions import taxon
from closura.operators import taxonomy as tx
from closura.operators import tree as tr
from helpers import cells, wide

LINEAGES = {
    "F1": "d__B; p__Firm; c__[Clos]; o__O1; f__; g__G1; s__",
    "F2": "d__B; p__Firm; c__Clos; o__O1; f__Fa; g__; s__",
    "F3": "d__B; p__Firm; c__Bac; o__; f__Fb; g__G3",
    "F4": "d__B; p__; c__",
}


@pytest.fixture()
def tax(spark):
    return spark.createDataFrame([(k, v, 0.9) for k, v in LINEAGES.items()], "feature_id string, taxon string, confidence double")


def test_entities(tax):
    got = {r["feature_id"]: (r["c"], r["s"], r["f"]) for r in tax.select(
        "feature_id", taxon.tax_entity(F.col("taxon"), "class").alias("c"), taxon.tax_entity(F.col("taxon"), "species").alias("s"),
        taxon.tax_label_with_parent(F.col("taxon"), "family").alias("f")).collect()}
    assert [got[f][0] for f in LINEAGES] == ["c__Clos", "c__Clos", "c__Bac", "c__unknown"]
    assert {v[1] for v in got.values()} == {"s__unknown"}
    assert [got[f][2] for f in LINEAGES] == ["f__unkn_o__O1", "f__Fa", "f__Fb", "f__unkn_o__unknown"]


def test_parent_of_unknown_can_be_unknown(tax):
    row = tax.where("feature_id = 'F4'").select(taxon.tax_label_with_parent(F.col("taxon"), "class").alias("v")).first()
    assert row["v"] == "c__unkn_p__unknown"


def test_aggregation_and_unmatched(spark, tax):
    a = cells(spark, {"F1": [0.1], "F2": [0.2], "F3": [0.3], "F9": [0.4]})
    assert wide(tx.aggregate_features(a, "tax_class", tax)) == {"c__Clos": {"s1": pytest.approx(0.3)}, "c__Bac": {"s1": 0.3}}
    assert [r[0] for r in tx.unmatched_features(a, tax).collect()] == ["F9"]
    with pytest.warns(UserWarning, match="without a taxonomy row"):
        tx.aggregate_universe(a.select("feature_id").distinct(), tx.feature_labels(tax, "class"))
    with pytest.raises(ValueError, match="unknown aggregation"):
        tx.aggregate_features(a, "tax_species", tax)


def test_align_taxonomy(spark, tax):
    assert {r["feature_id"] for r in tx.align_taxonomy(tax, cells(spark, {"F1": [1.0], "F8": [1.0]})).collect()} == {"F1"}
    with pytest.raises(ValueError, match="no feature of the table"):
        tx.align_taxonomy(tax, cells(spark, {"X": [1.0]}))


def edges(spark, rows):
    """(node, parent, ord); tips are those that are nobody's parent."""
    parents = {p for _, p, _ in rows}
    return spark.createDataFrame([(n, p, n not in parents, o) for n, p, o in rows], "node string, parent string, is_tip boolean, ord long")


def test_matrix_of_small_tree(spark):
    e = edges(spark, [("F1", "node1", 1), ("F2", "node1", 2), ("F3", "node2", 3), ("node1", "node2", 10)])
    m = tr.tip_ancestors(e).collect()
    assert {(r["tip"], r["node"]) for r in m} == {("F1", "F1"), ("F2", "F2"), ("F3", "F3"), ("F1", "node1"), ("F2", "node1")}
    assert {r["n_leaves"] for r in m if r["node"] == "node1"} == {2}


def test_equal_leaf_sets_collapse_to_the_first(spark):
    e = edges(spark, [("F1", "n1", 1), ("F2", "n1", 2), ("F3", "n3", 3), ("n3", "n2", 11), ("n1", "n4", 10), ("n2", "n4", 12)])
    inner = {r["node"] for r in tr.tip_ancestors(e).where("not is_tip").collect()}
    assert inner == {"n1", "n3"}


def test_a_node_over_all_leaves_is_an_error(spark):
    e = edges(spark, [("F1", "top", 1), ("F2", "top", 2), ("top", "root", 3)])
    with pytest.raises(Exception, match="covers every leaf"):
        tr.tip_ancestors(e).collect()


def test_deep_chain_needs_few_rounds(spark):
    rows = [("F0", "n0", 0), ("F1", "n0", 1)] + [(f"n{i}", f"n{i + 1}", 100 + i) for i in range(20)] + [("F2", "n20", 2)]
    paths = {r["node"]: r["path"] for r in tr.ancestor_paths(edges(spark, rows)).collect()}
    assert paths["F0"] == [f"n{i}" for i in range(20)]


def test_cycle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(tr, "MAX_DOUBLINGS", 3)
    with pytest.raises(ValueError, match="cycle"):
        tr.ancestor_paths(spark.createDataFrame([("a", "b", False, 1), ("b", "a", False, 2)], "node string, parent string, is_tip boolean, ord long"))


def test_prune_tree(spark):
    rows = [("F1", "a", 1), ("F4", "a", 4), ("F2", "b", 2), ("F3", "b", 3), ("a", "c", 10), ("b", "c", 11), ("c", "root", 12),
            ("F5", "d", 5), ("F6", "d", 6), ("d", "e", 13), ("F7", "e", 7), ("e", "root", 14)]
    feats = spark.createDataFrame([(f"F{i}",) for i in range(1, 7)], "feature_id string")
    got = {r["node"]: r["parent"] for r in tr.prune_tree(edges(spark, rows), feats).collect()}
    assert got == {"F1": "a", "F4": "a", "F2": "b", "F3": "b", "a": "c", "b": "c", "c": "root", "F5": "d", "F6": "d", "d": "root"}


def test_node_names(spark):
    tax = spark.createDataFrame([
        ("F1", "d__B; p__P; g__G1; s__S1", 1.0), ("F2", "d__B; p__P; g__G1; s__S2", 1.0), ("F3", "d__B; p__P; g__G2", 1.0),
        ("F4", "d__B; p__P; g__G2", 1.0), ("F5", "x", 1.0)], "feature_id string, taxon string, confidence double")
    e = edges(spark, [("F1", "n1", 1), ("F2", "n1", 2), ("F3", "n2", 3), ("F4", "n3", 4), ("n1", "n2", 10), ("n2", "n3", 11), ("n3", "root", 12), ("F5", "root", 5)])
    got = {r["node"]: r["name"] for r in tr.node_names(tr.tip_ancestors(e), tax).collect()}
    assert got["F1"] == "d__B; p__P; g__G1; s__S1; otu__F1"
    assert got["n1"] == "d__B; p__P; g__G1"
    assert got["n2"] == "d__B; p__P" and got["n3"] == "d__B; p__P; n__12"


def test_names_without_common_rank_are_empty(spark):
    df = spark.createDataFrame([("ab; c", "ax; c"), ("abc", "abc; d"), ("p; q; r1", "p; q; r2")], "a string, b string")
    got = [r[0] for r in df.select(taxon.before_last_semicolon(taxon.common_prefix(F.col("a"), F.col("b")))).collect()]
    assert got == ["", "", "p; q"]


def test_log_geom(spark):
    x = np.array([[0.1, 0.8, 0.1], [0.2, 0.7, 0.1], [0.0, 0.0, 1.0]])
    ids = ["s1", "s2", "s3"]
    a = cells(spark, {f"F{j + 1}": x[:, j] for j in range(3)})
    e = edges(spark, [("F1", "node1", 1), ("F2", "node1", 2), ("F3", "node2", 3), ("node1", "node2", 10)])
    m = tr.tip_ancestors(e)
    cols = tr.matrix_columns(m)
    assert [r["n_leaves"] for r in cols.orderBy("col").collect()] == [1, 1, 1, 2]
    got = {r["sample_id"]: r["x"] for r in tr.log_geom(spark.createDataFrame([(i,) for i in ids], "sample_id string"), a, m, cols).collect()}
    logs = np.log(x + 1e-9)
    want = np.column_stack([logs, logs[:, :2].mean(axis=1)])
    assert np.allclose([got[i] for i in ids], want)


@pytest.mark.parametrize("rows", [
    [("a", "b", False, 1), ("b", "a", False, 2)], [("a", "a", True, 1)],
    [("t", "a", True, 1), ("a", "b", False, 2), ("b", "c", False, 3), ("c", "a", False, 4), ("u", "root", True, 5)]])
def test_cycles_are_refused_at_once(spark, rows):
    edges = spark.createDataFrame(rows, "node string, parent string, is_tip boolean, ord int")
    began = time.time()
    with pytest.raises(ValueError, match="cycle"):
        tr.tip_ancestors(edges)
    assert time.time() - began < 30


def test_deep_chains_still_close(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}" if i < 99 else "root", i == 0, i) for i in range(100)]
    edges = spark.createDataFrame(rows, "node string, parent string, is_tip boolean, ord int")
    assert len(tr.ancestor_paths(edges).where("node = 'n000'").first()["path"]) == 99
