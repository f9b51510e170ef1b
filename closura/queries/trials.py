"""Trial tables drawn from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura import bindings as b
from closura.operators import trials as t
from closura.oracle import rd, with_
from closura.queries import query


def _round(df, *cols):
    return df.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


_AGG = """agg AS (SELECT trial, metric, avg(value) AS mean, stddev_samp(value) AS std, stddev_samp(value) / sqrt(count(value)) AS se, count(*) AS n_folds
  FROM folds GROUP BY 1, 2)"""


@query("A16_aggregate_folds", with_(b.FOLDS, _AGG, select=f"SELECT trial, metric, {rd('mean')} AS mean, {rd('std')} AS std, {rd('se')} AS se, n_folds FROM agg"))
def _(spark, sf):
    return _round(t.aggregate_folds(b.fold_metrics(spark, sf)), "mean", "std", "se")


@query(
    "A17_running_folds",
    with_(
        b.FOLDS,
        "r AS (SELECT trial, metric, fold, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std, count(value) OVER w AS n FROM folds WINDOW w AS (PARTITION BY trial, metric ORDER BY fold ROWS UNBOUNDED PRECEDING))",
        select=f"SELECT trial, metric, fold, {rd('mean')} AS mean, {rd('std')} AS std, {rd('std / sqrt(n)')} AS se, n AS n_folds FROM r WHERE fold < 4",
    ),
)
def _(spark, sf):
    return _round(t.running_folds(b.fold_metrics(spark, sf), 5), "mean", "std", "se")


def _trials_with_features(spark, sf):
    folds = t.aggregate_folds(b.fold_metrics(spark, sf)).select("trial", F.col("mean").alias("rmse_val_mean"), F.col("se").alias("rmse_val_se"))
    k = b.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("trial")).agg(
        F.max(F.get_json_object("props", "$.k").cast("int")).alias("nb_features"), F.min("value").alias("alpha")
    )
    return folds.join(k, "trial")


_FEATURED = """ft AS (SELECT user_id::VARCHAR AS trial, max(json_extract_string(props, '$.k')::INTEGER) AS nb_features, min(value) AS alpha FROM events GROUP BY 1),
tr AS (SELECT trial, mean, se, nb_features, alpha FROM agg JOIN ft USING (trial)),
best AS (SELECT mean AS bm, se AS bs FROM tr WHERE se IS NOT NULL ORDER BY {s} * mean, trial LIMIT 1)"""


def _one_se(mode: str, sign: int) -> None:
    @query(
        f"T10_select_one_se_{mode}",
        with_(
            b.FOLDS, _AGG, _FEATURED.format(s=sign),
            select=f"""SELECT trial, {rd('mean')} AS rmse_val_mean, {rd('se')} AS rmse_val_se, nb_features, alpha FROM tr, best
  WHERE se IS NOT NULL AND {sign} * (mean - bm) <= bs ORDER BY nb_features, -alpha, {sign} * mean, trial LIMIT 1""",
        ),
    )
    def _(spark, sf):
        best = t.select_one_se(_trials_with_features(spark, sf), "rmse_val", mode, "linreg")
        return _round(best, "rmse_val_mean", "rmse_val_se")


_one_se("min", 1)
_one_se("max", -1)

_RUNS = """runs AS (SELECT event_id, 'run' || event_id::VARCHAR AS run_id, 'exp' || (user_id % 5)::VARCHAR AS experiment_id,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS status, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + event_id % 1000 AS end_ms,
  json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'shannon' ELSE 'None' END AS data_enrich, value, event_type FROM events)"""


def _experiments(spark, sf):
    return b.table(spark, sf, "nation").where("n_nationkey < 4").select(
        F.concat(F.lit("exp"), F.col("n_nationkey").cast("string")).alias("experiment_id"), F.col("n_name").alias("experiment_name")
    )


@query(
    "S7_trial_log",
    with_(
        _RUNS,
        "ex AS (SELECT 'exp' || n_nationkey::VARCHAR AS experiment_id, n_name AS experiment_name FROM nation WHERE n_nationkey < 4)",
        select="""SELECT run_id, experiment_id, coalesce(experiment_name, '') AS experiment_name, status, epoch_ms(start_ms) AS start_time, epoch_ms(end_ms) AS end_time,
  data_enrich AS "params.data_enrich", k AS "params.k", value AS "metrics.rmse_val", event_type AS "tags.model_type" FROM runs LEFT JOIN ex USING (experiment_id)""",
    ),
)
def _(spark, sf):
    return t.trial_log(b.event_runs(spark, sf), _experiments(spark, sf))


@query("F19_epoch_ms", "SELECT event_id, epoch_ms((epoch_us(ts) // 1000) + event_id) AS t FROM events")
def _(spark, sf):
    from closura.functions.rows import epoch_ms

    return b.table(spark, sf, "events").select("event_id", epoch_ms(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id")).alias("t"))


def _history(spark, sf):
    ev = b.table(spark, sf, "events")
    runs = ev.groupBy("user_id").agg(F.min("event_type").alias("model_type")).select(
        F.col("user_id").cast("string").alias("run_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), "model_type"
    )
    # a run logs its points in batches, one row each, as a tracking store pages them
    points = ev.groupBy(F.col("user_id").cast("string").alias("run_id"), F.to_date("ts").alias("page"), F.lit("loss").alias("metric")).agg(
        F.collect_list(F.struct((F.col("event_id") % 10).cast("int").alias("step"), "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))).alias("points")
    )
    return runs, points


_HIST = """mt AS (SELECT user_id, min(event_type) AS model_type FROM events GROUP BY 1),
hist AS (SELECT user_id::VARCHAR AS run_id, 'u' || user_id::VARCHAR AS name, model_type, (event_id % 10)::INTEGER AS step, value, epoch_ms((epoch_us(ts) // 1000)) AS ts
  FROM events JOIN mt USING (user_id))"""


@query("S10_metric_history", with_(_HIST, select="SELECT * FROM hist WHERE model_type = 'click'"))
def _(spark, sf):
    runs, points = _history(spark, sf)
    return t.metric_history(runs, points, "loss", "click")


@query("A25_history_stats", with_(_HIST, select=f"SELECT model_type, step, {rd('avg(value)')} AS mean, {rd('stddev_samp(value)')} AS std FROM hist GROUP BY 1, 2"))
def _(spark, sf):
    runs, points = _history(spark, sf)
    kinds = [r[0] for r in runs.select("model_type").distinct().collect()]
    parts = [t.metric_history(runs, points, "loss", k) for k in sorted(kinds)]
    hist = parts[0]
    for p in parts[1:]:
        hist = hist.unionByName(p)
    return _round(t.history_stats(hist), "mean", "std")


@query(
    "A24_metric_quartiles",
    f"SELECT event_type, {rd('quantile_cont(value, 0.25)')} AS q1, {rd('quantile_cont(value, 0.5)')} AS median, {rd('quantile_cont(value, 0.75)')} AS q3 FROM events GROUP BY 1",
)
def _(spark, sf):
    ev = b.table(spark, sf, "events")
    return _round(t.metric_quartiles(ev, "value", "event_type", "event_id"), "q1", "median", "q3")


@query(
    "A18_failure_summary",
    with_(_RUNS, select="SELECT count(*) AS num_trials, count_if(status = 'FAILED') AS num_errors, round(count_if(status = 'FAILED') / count(*), 9) AS failure_rate, 'error' AS error_classes FROM runs"),
)
def _(spark, sf):
    runs = b.event_runs(spark, sf).withColumn("error_class", F.when(F.col("status") == "FAILED", F.col("tags")["model_type"]))
    return _round(t.failure_summary(runs), "failure_rate").withColumn("error_classes", F.array_join("error_classes", ","))


@query("P13_varying_columns", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(spark, sf):
    """Columns that hold one value, besides nulls and NaN, go."""
    nan = F.when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(3.0))
    return t.varying_columns(b.table(spark, sf, "events").withColumns({"fixed": F.lit("x"), "one_or_nan": nan}))


@query("P14_surviving_trials", with_(_RUNS, select="SELECT CASE WHEN status = 'FINISHED' THEN 'kept' ELSE 'skipped' END AS outcome, run_id FROM runs WHERE status = 'FINISHED' OR value IS NOT NULL"))
def _(spark, sf):
    runs = b.event_runs(spark, sf).withColumn("rmse_val", F.col("metrics")["rmse_val"])
    kept, skipped = t.surviving_trials(runs, "rmse_val")
    return kept.select(F.lit("kept").alias("outcome"), "run_id").unionByName(skipped.select(F.lit("skipped").alias("outcome"), "run_id"))


@query("P14_trials_of_model", "SELECT event_id, value FROM events WHERE event_type = 'click'")
def _(spark, sf):
    return t.trials_of(b.table(spark, sf, "events"), "click", "event_type").select("event_id", "value")


@query("T11_top_trials", "SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 25")
def _(spark, sf):
    return t.top_trials(b.table(spark, sf, "events"), "value", 25, tie="event_id").select("event_id", "value")


@query("T12_trial_axes", "SELECT event_id, value, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type_code FROM events WHERE value IS NOT NULL")
def _(spark, sf):
    return t.trial_axes(b.table(spark, sf, "events"), ["value", "event_type"], tie="event_id")


_W = "SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {a} PRECEDING AND {z} FOLLOWING), 9) AS smoothed FROM events"


@query("W3_rolling_mean_by_type", _W.format(a=10, z=9))
def _(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return _round(t.rolling_mean(ev, "value", "ts", 20, "event_id", ["event_type"]), "smoothed").select("event_id", "event_type", "smoothed")


@query("W3_rolling_mean", _W.format(a=2, z=2).replace("PARTITION BY event_type ", ""))
def _(spark, sf):
    ev = b.table(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    return _round(t.rolling_mean(ev, "value", "ts", 5, "event_id"), "smoothed").select("event_id", "event_type", "smoothed")


_LOG = """SELECT run_id, nb, CASE event_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'shannon' WHEN 2 THEN 'metadata_only' ELSE 'shannon_and_metadata' END AS enrich,
  CASE WHEN event_id % 4 >= 2 THEN 2 ELSE 0 END AS n_with, event_id % 4 AS e FROM (SELECT event_id, 'run' || event_id::VARCHAR AS run_id, event_id % 6 AS nb FROM events)"""


@query(
    "F18_post_process_trials",
    f"""WITH l AS ({_LOG}) SELECT run_id, CASE WHEN nb - (CASE e WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN n_with ELSE n_with + 1 END) = 1 THEN 'None' ELSE 'clr' END AS transform FROM l""",
)
def _(spark, sf):
    e = F.col("event_id") % 4
    log = b.table(spark, sf, "events").select(
        F.concat(F.lit("run"), F.col("event_id").cast("string")).alias("run_id"),
        (F.col("event_id") % 6).alias("metrics.nb_features"),
        F.when(e == 0, "None").when(e == 1, "shannon").when(e == 2, "metadata_only").otherwise("shannon_and_metadata").alias("params.data_enrich"),
        F.when(e >= 2, "['md1', 'md2']").otherwise("None").alias("params.data_enrich_with"),
        F.lit("clr").alias("params.data_transform"),
    )
    return t.post_process_trials(log).select("run_id", F.col("`params.data_transform`").alias("transform"))


@query(
    "M13_best_iteration",
    """SELECT trial, CASE WHEN count(i) < 5 THEN 100 ELSE floor(quantile_cont(i, 0.5))::INTEGER + 1 END AS n_estimators FROM (
  SELECT user_id::VARCHAR AS trial, event_id % 5 AS fold, max(json_extract_string(props, '$.k')::INTEGER) AS i FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    iters = b.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("trial"), (F.col("event_id") % 5).alias("fold")).agg(
        F.max(F.get_json_object("props", "$.k").cast("int")).alias("best_iter")
    )
    return t.best_iteration(iters, 5, 100)
