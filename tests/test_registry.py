"""Registered queries against their SQL twins on the smallest tables.

By default one query per family; CLOSURA_FULL=1 runs them all (as does check.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = (
    "P4_to_relative T1_select_abundance_ith F3_ilr F6_rank_row A4_aggregate_by_class P11_prune_tree F13_consensus_taxon M1_engineer "
    "M3_engineer_folds_alr M4_design_with_unseen_features J2_windows_nan W1_last_per_time K4_split_grouped_stratified "
    "K9_folds_grouped_stratified A19_regression_metrics A23_roc_auc_multiclass A16_aggregate_folds T10_select_one_se_min "
    "S7_trial_log W3_rolling_mean_by_type A27_gram M14_candidates S2_read_features_wide"
).split()
CHOSEN = sorted(ORACLES) if os.environ.get("CLOSURA_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, sf, name):
    status, _took, rows, note = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert status == "ok", note
    assert rows > 0 or name.startswith("P11")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["sample_id", "feature_id", "clr"] and df.count() > 0
