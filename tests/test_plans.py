"""What the plans must not contain, whatever the data size."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from closura import bindings as b
from closura.operators import prepare as prep
from closura.operators import snapshot as snap
from closura.operators import splits as sp
from closura.operators import taxonomy as tx
from closura.operators import metrics as m
from closura.operators.ordered import hash_rank, ordered_prefix
from closura.plans import engineer as eng

ROOT = Path(__file__).resolve().parents[1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


CASES = {
    "closure": lambda s, d: prep.to_relative(b.basket_cells(s, d)),
    "zero_removal": lambda s, d: prep.drop_zero_features(b.basket_cells(s, d)),
    "alignment": lambda s, d: prep.align_samples(b.customers(s, d), b.basket_cells(s, d))[1],
    "windows": lambda s, d: snap.window_links(b.activity_samples(s, d), "host", "time", 2, "nan"),
    "stratified_split": lambda s, d: sp.split(b.customers(s, d), 0.8, 1, stratify=["segment"]),
    "stratified_rank": lambda s, d: hash_rank(b.customers(s, d), ["segment"], "sample_id", 1),
    "keyed_prefix": lambda s, d: ordered_prefix(b.basket_cells(s, d), ["feature_id"], [F.col("value"), F.col("sample_id")], value="value"),
    "taxonomy": lambda s, d: tx.aggregate_by_taxonomy(b.basket_cells(s, d), b.supplier_lineage(s, d), "class"),
    "confusion": lambda s, d: m.confusion_metrics(m.confusion(b.segment_predictions(s, d))),
    "auc": lambda s, d: m.roc_auc(b.segment_predictions(s, d), ["F", "O", "P"]),
    "engineer": lambda s, d: eng.engineer(b.basket_dataset(s, d), eng.Config(selection="abundance_topi", i=5, transform="clr"))[0],
}


@pytest.mark.parametrize("name", CASES)
def test_no_cross_join_and_no_single_partition(spark, sf, name):
    text = plan(CASES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SinglePartition" not in text


def test_only_histograms_and_chunk_totals_meet_in_one_partition(spark, sf):
    """Without keys a single partition holds the per-bucket or per-chunk totals, never rows."""
    for df in (
        hash_rank(b.customers(spark, sf), [], "sample_id", 1),
        ordered_prefix(b.customers(spark, sf).select("sample_id", "acctbal"), [], [F.col("acctbal"), F.col("sample_id")]),
    ):
        lines = plan(df).splitlines()
        at = [i for i, line in enumerate(lines) if "SinglePartition" in line]
        assert len(at) == 1
        assert "HashAggregate" in lines[at[0] + 1]


def test_scan_reads_only_needed_columns(spark, sf):
    text = plan(b.basket_cells(spark, sf))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any(set(re.findall(r"(\w+):", s)) == {"l_orderkey", "l_suppkey", "l_quantity"} for s in schemas)
    assert any(set(re.findall(r"(\w+):", s)) == {"o_orderkey", "o_custkey"} for s in schemas)


def test_filter_reaches_the_scan(spark, sf):
    df = b.table(spark, sf, "events").where("event_type = 'click'").select("value")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan(df)


def test_source_has_no_forced_broadcast_or_local_checkpoint():
    """The optional llm subpackage has a rule of its own: it broadcasts behind a count of the rows."""
    for path in (ROOT / "closura").rglob("*.py"):
        if path.parent.name == "llm":
            continue
        text = path.read_text()
        assert "broadcast(" not in text and "localCheckpoint" not in text and "crossJoin" not in text, path
