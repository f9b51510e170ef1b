"""The driver's tables seen as samples, cells, lineages, trees, predictions and trials.

Every binding is written twice: as a DataFrame and as the SQL that the oracle uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.dataset import Dataset
from closura.operators.prepare import prepare_features
from closura.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- baskets: customer x supplier, quantity -----------------------------------------------


def basket_cells(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("sample_id"))
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_suppkey").cast("string").alias("feature_id"), "l_quantity"
    )
    return (
        items.join(orders, items.l_orderkey == orders.o_orderkey)
        .groupBy("sample_id", "feature_id")
        .agg(F.sum("l_quantity").alias("value"))
    )


CELLS = """cells AS (
  SELECT o_custkey::VARCHAR AS sample_id, l_suppkey::VARCHAR AS feature_id, sum(l_quantity) AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def basket_cells_with_zeros(spark: SparkSession, sf: str) -> DataFrame:
    """As above with explicit zero cells for every tenth supplier."""
    value = F.when(F.col("feature_id").cast("bigint") % 10 == 0, 0.0).otherwise(F.col("value"))
    return basket_cells(spark, sf).withColumn("value", value)


CELLS_ZERO = (
    CELLS
    + """, zcells AS (
  SELECT sample_id, feature_id, CASE WHEN feature_id::BIGINT % 10 = 0 THEN 0.0::DOUBLE ELSE value END AS value FROM cells)"""
)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"),
    )


CUSTOMERS = """customers AS (
  SELECT c_custkey::VARCHAR AS sample_id, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS acctbal
  FROM customer)"""


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared cells: prefixed, zero-free, closed."""
    return prepare_features(basket_cells(spark, sf))


PREPARED = (
    CELLS
    + """, totals AS (SELECT sample_id, sum(value) AS total FROM cells GROUP BY 1),
abund AS (SELECT sample_id, 'F' || feature_id AS feature_id, value / total AS value
          FROM cells JOIN totals USING (sample_id) WHERE value <> 0)"""
)


def basket_dataset(spark: SparkSession, sf: str) -> Dataset:
    return _dataset(spark, sf, baskets(spark, sf))


def _dataset(spark: SparkSession, sf: str, prepared: DataFrame) -> Dataset:
    """Samples, cells and the list of features, each written once: every fit and design starts from them."""
    cells = materialize(prepared)
    samples = customers(spark, sf).join(cells.select("sample_id").distinct(), "sample_id", "left_semi")
    ds = Dataset.static(materialize(samples), cells)
    return ds.with_(features=materialize(ds.features))


def skewed_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """As ``baskets``, with quantities halved again and again along the supplier key, so that a few
    suppliers hold most of the total. Powers of two keep every sum exact."""
    power = F.pow(F.lit(2.0), -((F.col("feature_id").cast("bigint") - 1) % 12))
    return prepare_features(basket_cells(spark, sf).withColumn("value", F.col("value") * power))


SKEWED = PREPARED.replace("sum(l_quantity) AS value", "sum(l_quantity) * pow(2.0, -((l_suppkey - 1) % 12)) AS value").replace(
    "GROUP BY 1, 2)", "GROUP BY 1, 2, l_suppkey)", 1
)


def skewed_dataset(spark: SparkSession, sf: str) -> Dataset:
    return _dataset(spark, sf, skewed_baskets(spark, sf))


# customers that have cells
ALIGNED = CUSTOMERS + ", samples AS (SELECT * FROM customers WHERE sample_id IN (SELECT sample_id FROM cells))"


# --- activity: (user, day) x event type ---------------------------------------------------


def activity_cells(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return (
        table(spark, sf, "events")
        .select(
            F.concat_ws("_", F.col("user_id").cast("string"), day.cast("string")).alias("sample_id"),
            F.col("event_type").alias("feature_id"),
        )
        .groupBy("sample_id", "feature_id")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


def activity_samples(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return (
        table(spark, sf, "events")
        .select(F.col("user_id").cast("string").alias("host"), day.alias("time"), "value")
        .groupBy("host", "time")
        .agg(F.max("value").alias("peak"))
        .select(F.concat_ws("_", "host", F.col("time").cast("string")).alias("sample_id"), "host", "time", "peak")
    )


ACTIVITY = """ev AS (SELECT user_id::VARCHAR AS host, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS time,
          event_type, value FROM events),
asamples AS (SELECT host || '_' || time::VARCHAR AS sample_id, host, time, max(value) AS peak FROM ev GROUP BY host, time),
acells AS (SELECT host || '_' || time::VARCHAR AS sample_id, event_type AS feature_id, count(*)::DOUBLE AS value
           FROM ev GROUP BY 1, 2),
atot AS (SELECT sample_id, sum(value) AS total FROM acells GROUP BY 1),
aprep AS (SELECT sample_id, 'F' || feature_id AS feature_id, value / total AS value FROM acells JOIN atot USING (sample_id))"""


# --- lineages and tree of suppliers -------------------------------------------------------


def supplier_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """feature_id, taxon, confidence; every tenth supplier has an empty order rank."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    mod = F.col("s_suppkey") % 10
    order = F.when(mod == 0, F.lit("o__")).otherwise(F.concat(F.lit("o__[g"), mod.cast("string"), F.lit("]")))
    nation = F.when(F.col("s_nationkey") % 6 == 0, F.lit("c__")).otherwise(F.concat(F.lit("c__"), "n_name"))
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("feature_id"),
            F.concat_ws(
                "; ",
                F.lit("d__world"),
                F.concat(F.lit("p__"), "r_name"),
                nation,
                order,
                F.concat(F.lit("f__"), (F.col("s_suppkey") % 7).cast("string")),
            ).alias("taxon"),
            (F.col("s_acctbal") / 10000).alias("confidence"),
        )
    )


LINEAGE = """lineage AS (
  SELECT 'F' || s_suppkey::VARCHAR AS feature_id,
    'd__world; p__' || r_name || '; ' || CASE WHEN s_nationkey % 6 = 0 THEN 'c__' ELSE 'c__' || n_name END || '; ' ||
    CASE WHEN s_suppkey % 10 = 0 THEN 'o__' ELSE 'o__[g' || (s_suppkey % 10)::VARCHAR || ']' END ||
    '; f__' || (s_suppkey % 7)::VARCHAR AS taxon, s_acctbal / 10000 AS confidence
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def supplier_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Edges child -> parent: supplier -> nation -> region -> root, with the child's order."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    tips = s.select(
        F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("node"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"),
        F.lit(True).alias("is_tip"),
        F.col("s_suppkey").cast("bigint").alias("ord"),
    )
    inner = n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
        F.lit(False).alias("is_tip"),
        F.col("n_nationkey").cast("bigint").alias("ord"),
    )
    top = r.select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"),
        F.lit("root").alias("parent"),
        F.lit(False).alias("is_tip"),
        (F.col("r_regionkey") + 100).cast("bigint").alias("ord"),
    )
    return tips.unionByName(inner).unionByName(top)


TREE = """edges AS (
  SELECT 'F' || s_suppkey::VARCHAR AS node, 'n' || s_nationkey::VARCHAR AS parent, true AS is_tip, s_suppkey AS ord FROM supplier
  UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'r' || n_regionkey::VARCHAR, false, n_nationkey FROM nation
  UNION ALL SELECT 'r' || r_regionkey::VARCHAR, 'root', false, r_regionkey + 100 FROM region)"""


# --- predictions --------------------------------------------------------------------------


def order_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals against the sum of their discounted lines; split by order key parity."""
    items = (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"))
    )
    orders = table(spark, sf, "orders")
    return orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        F.col("o_orderkey").cast("string").alias("sample_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_totalprice").alias("label"),
        "pred",
    )


ORDER_PREDS = """opreds AS (
  SELECT o_orderkey::VARCHAR AS sample_id, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split,
    o_orderpriority AS model, o_totalprice AS label, pred
  FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS pred
                    FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def document_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Binary labels of documents scored by their length (many ties)."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    score = F.floor(F.log1p(F.col("n_chars").cast("double"))) / 20 + (F.col("doc_id") % 7) / 100
    return lab.join(d, "doc_id").select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"),
        F.lit("length").alias("model"),
        F.col("quality").cast("string").alias("label"),
        F.round(score, 6).alias("p1"),
    )


DOC_PREDS = """dpreds AS (
  SELECT doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'length' AS model,
    quality::VARCHAR AS label, round(floor(ln(1 + n_chars::DOUBLE)) / 20 + (doc_id % 7) / 100, 6) AS p1
  FROM labels JOIN documents USING (doc_id))"""


def segment_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Three order states with made-up but deterministic class probabilities from the order itself."""
    a = 1 + F.col("o_orderkey") % 5 + F.when(F.col("o_orderstatus") == "F", 2).otherwise(0)
    b = 1 + F.col("o_custkey") % 4 + F.when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    c = 1 + (F.col("o_orderkey") + F.col("o_custkey")) % 3
    total = a + b + c
    return (
        table(spark, sf, "orders")
        .select(
            F.col("o_orderkey").cast("string").alias("sample_id"),
            F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"),
            F.lit("states").alias("model"),
            F.col("o_orderstatus").alias("label"),
            (a / total).alias("pf"),
            (b / total).alias("po"),
            (c / total).alias("pp"),
        )
        .withColumn(
            "pred",
            F.when((F.col("pf") >= F.col("po")) & (F.col("pf") >= F.col("pp")), "F")
            .when(F.col("po") >= F.col("pp"), "O")
            .otherwise("P"),
        )
        .select("sample_id", "split", "model", "label", "pred", F.array("pf", "po", "pp").alias("proba"))
    )


STATE_PREDS = """sraw AS (
  SELECT o_orderkey, o_orderstatus, 1 + o_orderkey % 5 + CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS a,
    1 + o_custkey % 4 + CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS b, 1 + (o_orderkey + o_custkey) % 3 AS c FROM orders),
spreds AS (
  SELECT o_orderkey::VARCHAR AS sample_id, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split,
    'states' AS model, o_orderstatus AS label,
    CASE WHEN a >= b AND a >= c THEN 'F' WHEN b >= c THEN 'O' ELSE 'P' END AS pred,
    a::DOUBLE / (a + b + c) AS pf, b::DOUBLE / (a + b + c) AS po, c::DOUBLE / (a + b + c) AS pp FROM sraw)"""


# --- trials -------------------------------------------------------------------------------


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One metric value per (trial, fold): users as trials, ``event_id % 5`` as fold."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").cast("string").alias("trial"), (F.col("event_id") % 5).cast("int").alias("fold"))
        .agg(F.avg("value").alias("value"))
        .select("trial", F.lit("rmse_val").alias("metric"), "fold", "value")
    )


FOLDS = """folds AS (
  SELECT user_id::VARCHAR AS trial, 'rmse_val' AS metric, (event_id % 5)::INTEGER AS fold, avg(value) AS value
  FROM events GROUP BY 1, 3)"""


def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per event, in the raw form of a tracking store."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("event_id").cast("string")).alias("run_id"),
        F.concat(F.lit("exp"), (F.col("user_id") % 5).cast("string")).alias("experiment_id"),
        F.when(F.col("event_type") == "error", "FAILED").otherwise("FINISHED").alias("status"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"),
        (F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000).alias("end_ms"),
        F.create_map(F.lit("k"), k, F.lit("data_enrich"), F.when(F.col("event_id") % 2 == 0, "shannon").otherwise("None")).alias("params"),
        F.create_map(F.lit("rmse_val"), F.col("value")).alias("metrics"),
        F.create_map(F.lit("model_type"), F.col("event_type")).alias("tags"),
    )
