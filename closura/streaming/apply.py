"""Applying a fitted design to samples that arrive as one row each.

Rows carry ``sample_id`` and ``cells`` (map<string,double>, already prefixed and closed).
Everything here is row-local, so the same call serves batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.functions.rows import array_sum
from closura.models.estimators import to_features
from closura.operators.enrich import SHANNON, shannon_term
from closura.plans.engineer import REFIT, Frozen, transform_dense
from closura.plans.search import TunedModel


def design_row(rows: DataFrame, frozen: Frozen) -> DataFrame:
    """sample_id, x for a fit without history, aggregation or metadata columns."""
    cfg = frozen.config
    if frozen.n_prev or cfg.aggregation or cfg.enrich not in (None, "shannon"):
        raise ValueError("only single-snapshot fits without aggregation and metadata are row-local")
    cols = frozen.columns.where(F.col("fit") == REFIT).orderBy("pos").collect()
    kept = [r["feature_id"] for r in cols if not r["is_group"]]
    denom = next((r["pos"] for r in cols if r["is_denom"]), None)
    ids = F.lit(kept)
    x = F.transform(ids, lambda k: F.coalesce(F.try_element_at("cells", k), F.lit(0.0)))
    if len(kept) < len(cols):
        rest = F.map_values(F.map_filter("cells", lambda k, _: ~F.array_contains(ids, k)))
        x = F.concat(x, F.array(array_sum(rest)))
    x = transform_dense(x, cfg.transform, F.lit(len(cols)), F.lit(denom))
    if cfg.enrich == "shannon":
        h = array_sum(F.transform(F.map_values("cells"), shannon_term))
        return rows.select("sample_id", F.concat(x, F.array(h)).alias("x")).withMetadata("x", {"enriched": SHANNON})
    return rows.select("sample_id", x.alias("x"))


def predict_rows(rows: DataFrame, tm: TunedModel) -> DataFrame:
    """sample_id, prediction for each arriving row."""
    x = design_row(rows, tm.frozen).select("sample_id", to_features(F.col("x"), tm.fitted.kind).alias("features"))
    return tm.fitted.score(x).drop("features")
