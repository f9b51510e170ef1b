"""Trial tables: fold statistics, the one-standard-error rule, logs and their summaries."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from closura.operators.ordered import exact_quantiles, ordered_prefix
from closura.operators.stats import category_universe

# Per model type the settings that make a model simpler; +1 = small is simple.
SIMPLICITY: dict[str, list[tuple[str, int]]] = {
    "linreg": [("alpha", -1), ("l1_ratio", -1)],
    "logreg": [("C", 1)],
    "log_contrast": [("lambda", -1)],
    "rf": [("n_estimators", 1), ("max_depth", 1), ("min_samples_leaf", -1)],
    "rf_class": [("n_estimators", 1), ("max_depth", 1), ("min_samples_leaf", -1)],
    "gbt": [("n_estimators", 1), ("max_depth", 1), ("gamma", -1), ("reg_alpha", -1), ("reg_lambda", -1)],
    "gbt_class": [("n_estimators", 1), ("max_depth", 1), ("gamma", -1), ("reg_alpha", -1), ("reg_lambda", -1)],
    "mlp_class": [("n_hidden_layers", 1)],
    "ordinal": [("C", 1)],
}
ROLLING_CHUNK = 100_000


def _valid(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def aggregate_folds(fold_metrics: DataFrame) -> DataFrame:
    """(trial, metric) -> mean, std, se, n_folds. NaN folds are left out; std and se are NULL with
    fewer than two valid folds; a metric without any valid fold has no row."""
    v = F.when(_valid(F.col("value")), F.col("value"))
    return (
        fold_metrics.groupBy("trial", "metric")
        .agg(
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("_n"), F.count(F.lit(1)).alias("n_folds"),
        )
        .where("_n > 0")
        .withColumn("std", F.when(F.col("_n") > 1, F.col("std")))
        .withColumn("se", F.col("std") / F.sqrt(F.col("_n")))
        .select("trial", "metric", "mean", "std", "se", "n_folds")
    )


def running_folds(fold_metrics: DataFrame, n_splits: int | None = None) -> DataFrame:
    """The same statistics after each fold; the last fold is left to the final report.
    A window partition holds one trial's folds."""
    w = Window.partitionBy("trial", "metric").orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.when(_valid(F.col("value")), F.col("value"))
    out = fold_metrics.select(
        "trial", "metric", "fold",
        F.avg(v).over(w).alias("mean"), F.stddev_samp(v).over(w).alias("std"), F.count(v).over(w).alias("_n"),
        F.count(F.lit(1)).over(w).cast("bigint").alias("n_folds"),
    ).where("_n > 0")
    if n_splits is not None:
        out = out.where(F.col("fold") < n_splits - 1)
    return (
        out.withColumn("std", F.when(F.col("_n") > 1, F.col("std")))
        .withColumn("se", F.col("std") / F.sqrt(F.col("_n")))
        .drop("_n")
    )


def surviving_trials(trials: DataFrame, metric: str, status: str = "status", ok: str = "FINISHED") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): trials that ended well, and those that reported the metric but did not."""
    done = F.col(status) == ok
    reported = _valid(F.col(metric))
    return trials.where(done), trials.where(~done & reported)


def trials_of(trials: DataFrame, model_type: str, column: str = "model_type") -> DataFrame:
    return trials.where(F.col(column) == model_type)


def _knob(trials: DataFrame, name: str, sign: int) -> Column:
    if name not in trials.columns:
        return F.lit(float("inf"))
    v = F.expr(f"try_cast(`{name}` as double)")
    return F.coalesce(F.lit(float(sign)) * v, F.lit(float("inf")))


def select_one_se(trials: DataFrame, metric: str, mode: str, model_type: str) -> DataFrame:
    """The simplest trial whose mean lies within one standard error of the best mean.

    Columns used: ``trial``, ``<metric>_mean`` (or ``<metric>``), ``<metric>_se``, ``nb_features``
    and the model's own settings; missing settings sort last. Without a finite standard error
    the best mean wins. One row.
    """
    sign = {"min": 1.0, "max": -1.0}[mode]
    mean = F.col(f"{metric}_mean") if f"{metric}_mean" in trials.columns else F.col(metric)
    if f"{metric}_mean" in trials.columns and metric in trials.columns:
        mean = F.coalesce(mean, F.col(metric))
    se = F.col(f"{metric}_se") if f"{metric}_se" in trials.columns else F.lit(None).cast("double")
    scored = trials.withColumns({"_m": mean, "_se": se}).where(_valid(F.col("_m")))
    reliable = scored.where(_valid(F.col("_se")))
    best = reliable.orderBy(F.lit(sign) * F.col("_m"), "trial").select("_m", "_se").first()
    if best is None:
        return scored.orderBy(F.lit(sign) * F.col("_m"), "trial").limit(1).drop("_m", "_se")
    band = reliable.where(F.lit(sign) * (F.col("_m") - F.lit(best["_m"])) <= F.lit(best["_se"]))
    order = [_knob(trials, "nb_features", 1)] + [_knob(trials, k, s) for k, s in SIMPLICITY.get(model_type, [])]
    return band.orderBy(*order, F.lit(sign) * F.col("_m"), "trial").limit(1).drop("_m", "_se")


def top_trials(trials: DataFrame, metric: str, n: int, mode: str = "min", tie: str = "run_id") -> DataFrame:
    c = F.col(metric)
    return trials.where(_valid(c)).orderBy(c.asc() if mode == "min" else c.desc(), tie).limit(n)


def failure_summary(trials: DataFrame) -> DataFrame:
    """One row: num_trials, num_errors, failure_rate, error_classes (sorted, distinct)."""
    return trials.agg(
        F.count(F.lit(1)).alias("num_trials"),
        F.count("error_class").alias("num_errors"),
        F.sort_array(F.collect_set("error_class")).alias("error_classes"),
    ).select(
        "num_trials", "num_errors",
        F.when(F.col("num_trials") > 0, F.col("num_errors") / F.col("num_trials")).alias("failure_rate"),
        "error_classes",
    )


def check_failures(trials: DataFrame, max_rate: float) -> dict:
    """Apply the failure policy: an error above ``max_rate`` or without trials, else a warning."""
    s = failure_summary(trials).first().asDict()
    if s["num_trials"] == 0:
        raise RuntimeError("The search produced 0 trials; check its budget and space.")
    text = f"{s['num_errors']}/{s['num_trials']} trials failed: {s['error_classes']}"
    if s["failure_rate"] > max_rate:
        raise RuntimeError(f"Trial failure rate {s['failure_rate']:.4f} exceeds {max_rate} ({text}).")
    if s["num_errors"]:
        warnings.warn(text, RuntimeWarning)
    return s


def best_iteration(fold_iters: DataFrame, k: int, fallback: int) -> DataFrame:
    """(trial, n_estimators) for the refit: median best iteration + 1, or the configured number
    when a fold is missing. A trial's group holds its K folds."""
    return fold_iters.groupBy("trial").agg(
        F.when(F.count("best_iter") < k, F.lit(fallback))
        .otherwise(F.floor(F.percentile("best_iter", 0.5)) + 1)
        .cast("int")
        .alias("n_estimators")
    )


# --- logs ---------------------------------------------------------------------------------


def trial_log(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """One wide row per run: params.*, metrics.*, tags.* from the maps, epoch-ms as timestamps, and
    the experiment's name ('' when unknown). Map keys are looked up per column: no shuffle of runs."""
    cols = []
    for kind in ("params", "metrics", "tags"):
        keys = sorted(r[0] for r in runs.select(F.explode(F.map_keys(kind))).distinct().collect())
        cols += [F.col(kind)[k].alias(f"{kind}.{k}") for k in keys]
    start, end = F.col("start_ms"), F.col("end_ms")
    return runs.join(experiments, "experiment_id", "left").select(
        "run_id", "experiment_id", F.coalesce("experiment_name", F.lit("")).alias("experiment_name"), "status",
        F.timestamp_millis(start).alias("start_time"), F.timestamp_millis(end).alias("end_time"), *cols,
    )


def metric_history(trials: DataFrame, history: DataFrame, metric: str, model_type: str) -> DataFrame:
    """run_id, name, model_type, step, value, ts for one metric of one model type. ``history`` holds
    per run and metric an array of (step, value, ts_ms)."""
    picked = trials.where(F.col("model_type") == model_type).select("run_id", "name", "model_type")
    points = history.where(F.col("metric") == metric).select("run_id", F.explode("points").alias("p"))
    return points.join(picked, "run_id").select(
        "run_id", "name", "model_type", "p.step", "p.value", F.timestamp_millis("p.ts_ms").alias("ts")
    )


def history_stats(history: DataFrame) -> DataFrame:
    return history.groupBy("model_type", "step").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def metric_quartiles(trials: DataFrame, metric: str, group: str, tie: str) -> DataFrame:
    """q1, median, q3 per group (the data of a box plot), by median."""
    valid = trials.where(_valid(F.col(metric)))
    return exact_quantiles(valid, [group], metric, tie, {"q1": 0.25, "median": 0.5, "q3": 0.75}).orderBy("median", group)


def varying_columns(trials: DataFrame, ignore: tuple[str, ...] = ("artifact_uri",)) -> DataFrame:
    """Only the columns with more than one distinct value besides null and NaN."""
    quoted = {c: F.col(f"`{c}`") for c in trials.columns if c not in ignore}
    floating = {c for c, kind in trials.dtypes if kind in ("float", "double")}
    value = {c: F.when(~F.isnan(q), q) if c in floating else q for c, q in quoted.items()}
    # smallest and largest differ exactly when there are two distinct values: no distinct expansion
    row = trials.agg(*[(F.min(q) < F.max(q)).alias(c) for c, q in value.items()]).first().asDict()
    return trials.select(*[quoted[c] for c in quoted if row[c]])


def post_process_trials(trials: DataFrame) -> DataFrame:
    """Where only one feature column was left, no transform was applied: set it to 'None'.
    The number of metadata columns follows from the enrichment parameters."""
    mode = F.col("`params.data_enrich`")
    n_with = F.lit(0)
    if "params.data_enrich_with" in trials.columns:
        raw = F.col("`params.data_enrich_with`")
        listed = F.from_json(F.translate(raw, "'", '"'), "array<string>")
        n_with = F.when(raw.isNull() | (raw == "None"), F.lit(0)).otherwise(F.size(listed))
    n_md = (
        F.when(mode == "None", 0).when(mode == "shannon", 1).when(mode == "metadata_only", n_with)
        .when(mode == "shannon_and_metadata", n_with + 1)
    )
    left = F.col("`metrics.nb_features`") - n_md
    return trials.withColumn(
        "params.data_transform", F.when(left == 1, F.lit("None")).otherwise(F.col("`params.data_transform`"))
    )


def trial_axes(trials: DataFrame, cols: list[str], tie: str = "run_id") -> DataFrame:
    """Complete rows of ``cols``; text columns get dense codes in sorted order (``<col>_code``)."""
    out = trials.select(tie, *[F.col(f"`{c}`") for c in cols])
    for c in cols:
        missing = F.col(f"`{c}`").isNull()
        if isinstance(out.schema[c].dataType, (DoubleType, FloatType)):
            missing = missing | F.isnan(f"`{c}`")
        out = out.where(~missing)
    for c in cols:
        if isinstance(out.schema[c].dataType, NumericType):
            continue
        codes = category_universe(out.select(F.col(f"`{c}`").alias("c")), ["c"]).select(
            F.col("category").alias(c), F.col("pos").alias(f"{c}_code")
        )
        out = out.join(codes, out[f"`{c}`"] == codes[f"`{c}`"]).drop(codes[f"`{c}`"])
    return out


def rolling_mean(df: DataFrame, y: str, time: str, window: int, tie: str, keys: list[str] | None = None) -> DataFrame:
    """Centred rolling mean over ``window`` rows in time order (at least one value).

    Rows are ranked by chunked prefix counts and cut into runs of ranks; each run is lent the
    few rows it needs from its neighbours, so no task sees a whole group.
    """
    keys = keys or []
    back, ahead = window // 2, (window - 1) // 2
    size = max(ROLLING_CHUNK, window)
    ranked = ordered_prefix(df, keys, [F.col(time), F.col(tie)])
    own = F.floor((F.col("rank") - 1) / size)
    lent = F.array_distinct(
        F.array(own, F.floor((F.col("rank") - 1 + back) / size), F.floor(F.greatest(F.col("rank") - 1 - ahead, F.lit(0)) / size))
    )
    spread = ranked.withColumn("_own", own).withColumn("_run", F.explode(lent))
    value = F.when(_valid(F.col(y).cast("double")), F.col(y))
    w = Window.partitionBy(*keys, "_run").orderBy("rank").rowsBetween(-back, ahead)
    return spread.withColumn("smoothed", F.avg(value).over(w)).where("_own = _run").drop("_own", "_run", "rank", "n")
