"""Scores of order, document and state predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura import bindings as b
from closura.functions import rows
from closura.operators import checks
from closura.operators import metrics as m
from closura.oracle import rd, with_
from closura.queries import query

STATES = ["F", "O", "P"]


def _round(df, *cols, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(
    "A19_regression_metrics",
    with_(
        b.ORDER_PREDS,
        select=f"""SELECT model, split, {rd('sqrt(avg((label - pred) ^ 2))', 4)} AS rmse,
  {rd('1 - sum((label - pred) ^ 2) / (var_pop(label) * count(*))')} AS r2, {rd('corr(label, pred)')} AS pearson, count(*) AS n FROM opreds GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return _round(_round(m.regression_metrics(b.order_predictions(spark, sf)), "r2", "pearson"), "rmse", digits=4)


@query("A19_pearson_pvalue")
def _(spark, sf):
    return m.with_p_value(m.regression_metrics(b.order_predictions(spark, sf))).select("model", "split", "pearson_pvalue")


@query("U1_stack_predictions", with_(b.STATE_PREDS, select="SELECT sample_id, model, label, pred, split FROM spreds"))
def _(spark, sf):
    p = b.segment_predictions(spark, sf).drop("proba")
    return m.stack_predictions(p.where("split = 'train'").drop("split"), p.where("split = 'test'").drop("split"))


@query("A20_confusion", with_(b.STATE_PREDS, select="SELECT model, split, label, pred, count(*) AS n FROM spreds GROUP BY ALL"))
def _(spark, sf):
    return m.confusion(b.segment_predictions(spark, sf))


_CONF = """cls AS (SELECT split, label AS k FROM spreds UNION SELECT split, pred FROM spreds),
pk AS (SELECT c.split, k, count_if(label = k)::DOUBLE AS t, count_if(pred = k)::DOUBLE AS p, count_if(label = k AND pred = k)::DOUBLE AS tp
       FROM cls c JOIN spreds s USING (split) GROUP BY 1, 2),
cm AS (SELECT split, avg(2 * tp / (t + p)) AS f1_macro, avg(CASE WHEN t > 0 THEN tp / t END) AS balanced_accuracy,
  (sum(tp) * sum(t) - sum(t * p)) / sqrt((sum(t) * sum(t) - sum(p * p)) * (sum(t) * sum(t) - sum(t * t))) AS mcc FROM pk GROUP BY 1)"""


@query("A21_confusion_metrics", with_(b.STATE_PREDS, _CONF, select=f"SELECT 'states' AS model, split, {rd('f1_macro')} AS f1_macro, {rd('balanced_accuracy')} AS balanced_accuracy, {rd('mcc')} AS mcc FROM cm"))
def _(spark, sf):
    return _round(m.confusion_metrics(m.confusion(b.segment_predictions(spark, sf))), "f1_macro", "balanced_accuracy", "mcc")


_LOSS = "ll AS (SELECT split, -avg(ln(CASE label WHEN 'F' THEN pf WHEN 'O' THEN po ELSE pp END)) AS log_loss FROM spreds GROUP BY 1)"


@query("A22_log_loss", with_(b.STATE_PREDS, _LOSS, select=f"SELECT 'states' AS model, split, {rd('log_loss')} AS log_loss FROM ll"))
def _(spark, sf):
    return _round(m.log_loss(b.segment_predictions(spark, sf), STATES), "log_loss")


def _auc_sql(src: str) -> str:
    return f"""SELECT split, cls, (sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2.0) / (count_if(pos) * count_if(NOT pos)) AS auc FROM (
  SELECT split, cls, pos, rank() OVER (PARTITION BY split, cls ORDER BY score) + (count(*) OVER (PARTITION BY split, cls, score) - 1) / 2.0::DOUBLE AS r FROM ({src})) GROUP BY 1, 2"""


_OVR = " UNION ALL ".join(f"SELECT split, '{c}' AS cls, label = '{c}' AS pos, round({p}, 12) AS score FROM spreds" for c, p in zip(STATES, ("pf", "po", "pp")))


def _rounded_states(spark, sf):
    return b.segment_predictions(spark, sf).withColumn("proba", F.transform("proba", lambda v: F.round(v, 12)))


@query("A23_roc_auc_multiclass", with_(b.STATE_PREDS, f"auc AS ({_auc_sql(_OVR)})", select=f"SELECT 'states' AS model, split, {rd('avg(auc)')} AS roc_auc_macro_ovr FROM auc GROUP BY 2"))
def _(spark, sf):
    return _round(m.roc_auc(_rounded_states(spark, sf), STATES), "roc_auc_macro_ovr")


@query(
    "A23_roc_auc_binary",
    with_(b.DOC_PREDS, f"auc AS ({_auc_sql('''SELECT split, '1' AS cls, label = '1' AS pos, p1 AS score FROM dpreds''')})", select=f"SELECT 'length' AS model, split, {rd('auc')} AS roc_auc_macro_ovr FROM auc"),
)
def _(spark, sf):
    p = b.document_predictions(spark, sf).withColumn("proba", F.array(1 - F.col("p1"), F.col("p1")))
    return _round(m.roc_auc(p, ["0", "1"]), "roc_auc_macro_ovr")


@query(
    "M19_classification_metrics",
    with_(
        b.STATE_PREDS, _CONF, _LOSS, f"auc AS ({_auc_sql(_OVR)})", "ma AS (SELECT split, avg(auc) AS a FROM auc GROUP BY 1)",
        select=f"""SELECT 'states' AS model, split, {rd('f1_macro')} AS f1_macro, {rd('balanced_accuracy')} AS balanced_accuracy, {rd('mcc')} AS mcc,
  {rd('log_loss')} AS log_loss, {rd('a')} AS roc_auc_macro_ovr FROM cm JOIN ll USING (split) JOIN ma USING (split)""",
    ),
)
def _(spark, sf):
    out = m.classification_metrics(_rounded_states(spark, sf), STATES)
    return _round(out, "f1_macro", "balanced_accuracy", "mcc", "log_loss", "roc_auc_macro_ovr")


_LOGITS = "lg AS (SELECT o_orderkey::VARCHAR AS sample_id, (o_orderkey % 7 - 3) / 2.0::DOUBLE AS a, (o_custkey % 5 - 2) / 2.0::DOUBLE AS b, (o_orderkey % 3 - 1) / 2.0::DOUBLE AS c FROM orders)"


def _logits(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return b.table(spark, sf, "orders").select(
        k.cast("string").alias("sample_id"), F.array((k % 7 - 3) / 2, (c % 5 - 2) / 2, (k % 3 - 1) / 2).alias("x")
    )


@query(
    "F16_corn",
    with_(
        _LOGITS,
        "s AS (SELECT sample_id, 1 / (1 + exp(-a)) AS s1, 1 / (1 + exp(-b)) AS s2, 1 / (1 + exp(-c)) AS s3 FROM lg)",
        "cum AS (SELECT sample_id, s1 AS c1, s1 * s2 AS c2, s1 * s2 * s3 AS c3 FROM s)",
        select=f"""SELECT sample_id, {rd('1 - c1')} AS p0, {rd('c1 - c2')} AS p1, {rd('c2 - c3')} AS p2, {rd('c3')} AS p3,
  ((c1 > 0.5)::INTEGER + (c2 > 0.5)::INTEGER + (c3 > 0.5)::INTEGER) AS label FROM cum""",
    ),
)
def _(spark, sf):
    p = rows.corn_proba(F.col("x"))
    return _logits(spark, sf).select("sample_id", p.alias("p"), rows.corn_label(F.col("x")).alias("label")).select(
        "sample_id", *[F.round(F.element_at("p", i + 1), 9).alias(f"p{i}") for i in range(4)], "label"
    )


@query(
    "F17_softmax_argmax",
    with_(
        _LOGITS,
        select=f"""SELECT sample_id, {rd('exp(a) / (exp(a) + exp(b) + exp(c))')} AS p0, {rd('exp(b) / (exp(a) + exp(b) + exp(c))')} AS p1,
  {rd('exp(c) / (exp(a) + exp(b) + exp(c))')} AS p2, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS top FROM lg""",
    ),
)
def _(spark, sf):
    return _logits(spark, sf).select("sample_id", rows.softmax(F.col("x")).alias("p"), rows.argmax(F.col("x")).alias("top")).select(
        "sample_id", *[F.round(F.element_at("p", i + 1), 9).alias(f"p{i}") for i in range(3)], "top"
    )


@query(
    "A13_null_counts",
    "SELECT count_if(a IS NULL) AS a, count_if(isnan(z)) AS z FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE c_acctbal END AS z FROM customer)",
)
def _(spark, sf):
    k = F.col("c_custkey")
    c = b.table(spark, sf, "customer").select(
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("a"),
        F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("z"),
        F.col("c_mktsegment").alias("segment"),
    )
    return checks.null_counts(c, ["a", "z", "segment"])


@query(
    "A14_snapshot_gaps",
    with_(b.ACTIVITY, select="""SELECT k::INTEGER AS t_off, count(*) AS n FROM asamples s CROSS JOIN range(1, 3) r(k)
  WHERE NOT EXISTS (SELECT 1 FROM asamples p WHERE p.host = s.host AND p.time = s.time - k) GROUP BY 1"""),
)
def _(spark, sf):
    from closura.operators.snapshot import missing_rows
    from closura.queries.features import activity_windows

    ds = activity_windows(spark, sf)
    parts = [missing_rows(ds, k).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("t_off"), "n") for k in (1, 2)]
    return parts[0].unionByName(parts[1])


@query("A15_ordinal_levels", "SELECT count(DISTINCT round_even(c_acctbal / 1000, 0)) AS levels, count_if(c_acctbal IS NULL) AS missing FROM customer")
def _(spark, sf):
    return checks.ordinal_levels(b.table(spark, sf, "customer").withColumn("y", F.col("c_acctbal") / 1000), "y")
