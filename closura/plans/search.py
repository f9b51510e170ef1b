"""Evaluate candidates over folds, pick one, refit it, predict and score."""

from __future__ import annotations

import json
import math
import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from closura.dataset import PSEUDOCOUNT, Dataset
from closura.models.explain import COEF_MODELS, coefficients, shapley_sample
from closura.models.estimators import CLASSIFIERS, ORDINAL, TREES, Fitted, fit_model, to_features
from closura.models.log_contrast import fit_log_contrast, predict_sparse
from closura.models.moments import BLOCK, linear_trials
from closura.models.tree_shap import tree_shapley
from closura.operators import metrics as m
from closura.operators.checks import check_enrich_nulls, check_ordinal_levels, check_snapshot_nulls
from closura.operators.splits import assign_folds
from closura.operators.stats import bounded_rows, bounds_of, feature_stats, label_index
from closura.operators.trials import aggregate_folds, best_iteration, check_failures, select_one_se
from closura.operators.tree import log_geom, log_geom_cells
from closura.plans.candidates import DATA_COLUMNS, SPACES, candidates, with_start_points
from closura.plans.engineer import REFIT, Config, Frozen, apply_engineering, design_names, engineer_folds, fit_engineering
from closura.session import materialize

# What a search minimises or maximises.
SELECTION_METRIC = {"regression": ("rmse_val", "min"), "classification": ("roc_auc_macro_ovr_val", "max")}
ORDINAL_CAP = 20
MAX_CLASSES = 10_000  # outputs of one model


@dataclass
class Tree:
    """Aggregation matrix and column order of a feature tree."""

    matrix: DataFrame
    columns: DataFrame

    def n_leaves(self) -> list[float]:
        return [float(r["n_leaves"]) for r in self.columns.orderBy("col").collect()]

    def names(self) -> list[str]:
        return [r["node"] for r in self.columns.orderBy("col").collect()]


@dataclass
class TunedModel:
    """A refitted model with the frozen engineering it expects."""

    fitted: Fitted
    config: Config
    frozen: Frozen | None
    classes: list[str] | None
    taxonomy: DataFrame | None = None
    tree: Tree | None = None

    @property
    def names(self) -> list[str]:
        return self.tree.names() if self.frozen is None else design_names(self.frozen)

    def design(self, ds: Dataset) -> DataFrame:
        """sample_id, x under the fit-time columns; the same code path as training."""
        if self.frozen is None:
            return log_geom(ds.samples, ds.abund, self.tree.matrix, self.tree.columns)
        return apply_engineering(ds, self.frozen, self.taxonomy, [REFIT]).drop("fit")

    def predict(self, ds: Dataset, target: str | None = None) -> DataFrame:
        """sample_id[, label], pred (class names for classifiers)[, proba]."""
        if self.frozen is None:
            out = self.predict_cells(log_geom_cells(ds.samples, ds.abund, self.tree.matrix, self.tree.columns))
        else:
            out = self.predict_design(self.design(ds))
        if target is not None:
            now = ds.samples.where("t_off = 0").select("sample_id", F.col(target).alias("label"))
            out = out.join(now, "sample_id")
        return out

    def predict_design(self, x: DataFrame) -> DataFrame:
        """sample_id, pred[, proba] of design rows (sample_id, x)."""
        features = x.select("sample_id", to_features(F.col("x"), self.fitted.kind).alias("features"))
        out = self.fitted.score(features).drop("features")
        pred = F.col("prediction")
        if self.classes is not None:
            pred = F.element_at(F.array(*[F.lit(c) for c in self.classes]), pred.cast("int") + 1)
        return out.withColumn("pred", pred).drop("prediction")

    def predict_cells(self, rows: DataFrame) -> DataFrame:
        """``rows`` of a log contrast (``contrast_rows``) with pred in place of their cells; no row is laid out."""
        return predict_sparse(self.fitted, rows, math.log(PSEUDOCOUNT))

    def predict_proba(self, ds: Dataset) -> DataFrame:
        """sample_id, class, proba aligned to the fitted classes."""
        if not self.fitted.has_proba:
            raise TypeError(f"{self.fitted.kind} has no class probabilities.")
        pairs = F.arrays_zip(F.array(*[F.lit(c) for c in self.classes]).alias("c"), F.col("proba").alias("p"))
        return self.predict(ds).select("sample_id", F.explode(pairs).alias("z")).select(
            "sample_id", F.col("z.c").alias("class"), F.col("z.p").alias("proba")
        )


def task_of(kind: str) -> str:
    return "classification" if kind in CLASSIFIERS else "regression"


def _target(ds: Dataset, target: str, kind: str, max_levels: int = ORDINAL_CAP) -> tuple[DataFrame, list[str] | None]:
    """(sample_id, y) and the class list; numeric targets of ordinal models are rounded levels."""
    now = ds.samples.where("t_off = 0").select("sample_id", F.col(target).alias("_t"))
    if kind in CLASSIFIERS:
        classes = [r["label"] for r in bounded_rows(label_index(now, "_t").orderBy("idx"), MAX_CLASSES, "classes")]
        lookup = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_t").cast("string")) - 1
        return now.select("sample_id", lookup.cast("double").alias("y")), classes
    if not isinstance(now.schema["_t"].dataType, NumericType):
        raise ValueError(f"{kind} needs a numeric target.")
    if kind == ORDINAL:
        check_ordinal_levels(now, "_t", max_levels)
        level = F.bround(F.col("_t").cast("double"), 0)
        levels = [r[0] for r in now.select(level.alias("l")).distinct().orderBy("l").collect()]
        code = F.array_position(F.array(*[F.lit(v) for v in levels]), level) - 1
        return now.select("sample_id", code.cast("double").alias("y")), [str(v) for v in levels]
    return now.select("sample_id", F.col("_t").cast("double").alias("y")), None


def _config(row: dict, enrich_with: tuple[str, ...]) -> Config:
    vals = {c: row.get(c) for c in DATA_COLUMNS}
    return Config(**vals, enrich_with=tuple(enrich_with) if vals["enrich"] in ("shannon_and_metadata", "metadata_only") else ())


def _params(row: dict, kind: str) -> dict:
    return {k: row.get(k) for k in SPACES[kind] if k in row}


def _score_rows(scored: DataFrame, kind: str, classes: list[str] | None) -> dict[str, float]:
    """Metric values per split of one fold's model, as a flat dict."""
    if kind in CLASSIFIERS:
        names = F.array(*[F.lit(c) for c in classes])
        preds = scored.select(
            F.lit(kind).alias("model"), "split", F.element_at(names, F.col("label").cast("int") + 1).alias("label"),
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"), "proba",
        )
        table = m.classification_metrics(materialize(preds), classes)
    else:
        preds = scored.select(F.lit(kind).alias("model"), "split", "label", F.col("prediction").alias("pred"))
        table = m.regression_metrics(preds).drop("n")
    return {
        f"{name}_{r['split']}": r[name] for r in (row.asDict() for row in table.collect()) for name in r if name not in ("model", "split")
    }


def _fit_fold(design: DataFrame, kind: str, params: dict, classes, fold: int, seed: int, tree: Tree | None):
    rows = design.where(F.col("fit") == fold)
    train = rows.where("split = 'train'")
    if kind == "log_contrast":
        fitted = fit_log_contrast(train, tree.n_leaves(), params["lambda"])
    else:
        val = rows.where("split = 'val'").select(to_features(F.col("x"), kind).alias("features"), F.col("y").alias("label"))
        fitted = fit_model(
            kind, train.select(to_features(F.col("x"), kind).alias("features"), F.col("y").alias("label")), params,
            n_classes=len(classes) if classes else None, val=val, seed=seed,
        )
    scored = fitted.score(rows.select("split", F.col("y").alias("label"), to_features(F.col("x"), kind).alias("features")))
    return fitted, _score_rows(scored, kind, classes)


def folds_of(ds: Dataset, k: int, seed: int, group: str | None, stratify: list[str] | None) -> DataFrame:
    return materialize(assign_folds(ds.samples.where("t_off = 0"), k, seed, group, stratify))


def evaluate_candidates(
    ds: Dataset,
    table: DataFrame,
    target: str,
    k: int,
    seed: int = 0,
    group: str | None = None,
    stratify: list[str] | None = None,
    taxonomy: DataFrame | None = None,
    tree: Tree | None = None,
    enrich_with: tuple[str, ...] = (),
    parallelism: int = 4,
    max_failure_rate: float = 0.5,
    max_levels: int = ORDINAL_CAP,
) -> DataFrame:
    """fold metrics (trial, metric, fold, value) plus nb_features and best_iter rows.

    ``table`` is the trial budget (tens of rows), so it is read to the driver; the data never is.
    Trials that share a data configuration share one engineered, written design table; model
    fits run as concurrent Spark jobs.
    """
    spark = ds.samples.sparkSession
    trials = [r.asDict() for r in table.orderBy("trial").collect()]
    if not trials:
        raise RuntimeError("No candidates.")
    kinds = {t["model_type"] for t in trials}
    check_snapshot_nulls(ds, sorted(kinds))
    folds = folds_of(ds, k, seed, group, stratify)
    out: list[tuple] = []
    errors: list[tuple] = []
    shared: dict = {}
    by_data: dict[tuple, list[dict]] = {}
    for t in trials:
        by_data.setdefault((t["model_type"] in TREES, t["model_type"] == "log_contrast", *[t.get(c) for c in DATA_COLUMNS]), []).append(t)
    targets = {kind: _target(ds, target, kind, max_levels) for kind in kinds}
    for members in by_data.values():
        kind0 = members[0]["model_type"]
        cfg = _config(members[0], enrich_with)
        if cfg.enrich_with:
            check_enrich_nulls(ds.samples.where("present"), list(cfg.enrich_with), sorted({t["model_type"] for t in members}))
        if kind0 == "log_contrast":
            if ds.n_prev:
                raise ValueError("log_contrast has no snapshots; leave it out for windowed data")
            x = log_geom(ds.samples, ds.abund, tree.matrix, tree.columns).join(folds, "sample_id")
            fits = F.array(*[F.lit(f) for f in range(k)])
            x = x.withColumn("fit", F.explode(fits)).withColumn("split", F.when(F.col("fold") == F.col("fit"), "val").otherwise("train"))
            x = x.select("sample_id", "fit", "split", "x")
        else:
            x, _ = engineer_folds(ds, folds, k, cfg, taxonomy, fits=list(range(k)), shared=shared)
        for kind in sorted({t["model_type"] for t in members}):  # one join with each type's target, none in a trial
            x = x.join(targets[kind][0].withColumnRenamed("y", f"y_{kind}"), "sample_id")
        x = materialize(x)
        width = {r["fit"]: r["w"] for r in x.groupBy("fit").agg(F.max(F.size("x")).alias("w")).collect()}

        def run(job):
            t, fold = job
            kind = t["model_type"]
            design = x.select("sample_id", "fit", "split", "x", F.col(f"y_{kind}").alias("y"))  # noqa: B023
            fitted, scores = _fit_fold(design, kind, _params(t, kind), targets[kind][1], fold, seed, tree)
            return fitted.meta.get("best_iter"), scores

        narrow = max(width.values(), default=0) + 2 <= BLOCK
        from_sums = [t for t in members if narrow and t["model_type"] == "linreg" and None not in (t.get("alpha"), t.get("l1_ratio"))]
        if from_sums:
            # all folds and penalties from the sums of one pass over the design
            wanted = [(str(t["trial"]), float(t["alpha"]), float(t["l1_ratio"])) for t in from_sums]
            try:
                found = linear_trials(x.select("fit", "split", "x", F.col("y_linreg").alias("y")), wanted).where("metric <> 'weights'").drop("w").collect()
                out += [(r["trial"], r["metric"], r["fit"], r["value"]) for r in found]
                out += [(trial, "nb_features", fold, float(w)) for trial, _, _ in wanted for fold, w in width.items()]
            except Exception as e:  # noqa: BLE001 - as below
                errors += [(t["trial"], type(e).__name__) for t in from_sums]
                warnings.warn(f"linear trials failed: {e}")
        jobs = [(t, fold) for t in members if t not in from_sums for fold in range(k)]
        with ThreadPoolExecutor(max(1, parallelism)) as pool:
            futures = [(job, pool.submit(run, job)) for job in jobs]
            for (t, fold), f in futures:
                try:
                    best, scores = f.result()
                except Exception as e:  # noqa: BLE001 - a failed trial must not end the search
                    errors.append((t["trial"], type(e).__name__))
                    warnings.warn(f"trial {t['trial']} fold {fold} failed: {e}")
                    continue
                out += [(str(t["trial"]), name, fold, None if v is None else float(v)) for name, v in scores.items()]
                out.append((str(t["trial"]), "nb_features", fold, float(width[fold])))
                if best is not None:
                    out.append((str(t["trial"]), "best_iter", fold, float(best)))
    failed = dict(errors)
    states = spark.createDataFrame([(str(t["trial"]), failed.get(t["trial"])) for t in trials], "trial string, error_class string")
    check_failures(states, max_failure_rate)
    return spark.createDataFrame(out, "trial string, metric string, fold int, value double")


def trial_scores(fold_metrics: DataFrame, metric: str) -> DataFrame:
    """trial, <metric>_mean, <metric>_se, nb_features."""
    agg = aggregate_folds(fold_metrics)
    return (
        agg.where(F.col("metric").isin(metric, "nb_features"))
        .groupBy("trial")
        .agg(
            F.max(F.when(F.col("metric") == metric, F.col("mean"))).alias(f"{metric}_mean"),
            F.max(F.when(F.col("metric") == metric, F.col("se"))).alias(f"{metric}_se"),
            F.max(F.when(F.col("metric") == "nb_features", F.col("mean"))).alias("nb_features"),
        )
    )


def data_bounds(ds: Dataset) -> tuple[int, dict[str, tuple[float, float]]]:
    """Number of feature columns over all snapshots, and the threshold ranges."""
    n = ds.samples.where("t_off = 0").count()
    names = ("abundance", "variance")
    stats = materialize(ds.features.join(feature_stats(ds.abund, n), "feature_id", "left").na.fill(0.0, list(names)))
    bounds = {}
    for measure in names:
        r = bounds_of(stats, measure).first()
        bounds[measure] = (float(r["lo"]), float(r["hi"]))
    return stats.count() * len(ds.offsets), bounds


def find_best(
    ds: Dataset,
    target: str,
    model_type: str,
    n_trials: int,
    k: int,
    seed: int = 0,
    group: str | None = None,
    stratify: list[str] | None = None,
    taxonomy: DataFrame | None = None,
    tree: Tree | None = None,
    enrich_with: tuple[str, ...] = (),
    overrides: dict | None = None,
    parallelism: int = 4,
    start_points: list[dict] | None = None,
    max_levels: int = ORDINAL_CAP,
) -> tuple[TunedModel, DataFrame]:
    """Draw candidates, evaluate them, apply the one-standard-error rule and refit on all rows.
    ``start_points`` (settings) take the place of the first trials' draws."""
    models, fold_metrics = find_best_of(
        ds, target, [model_type], n_trials, k, seed, group, stratify, taxonomy, tree, enrich_with, overrides, parallelism,
        {model_type: start_points or []}, max_levels,
    )
    return models[model_type], fold_metrics


def find_best_of(
    ds: Dataset,
    target: str,
    model_types: list[str],
    n_trials: int,
    k: int,
    seed: int = 0,
    group: str | None = None,
    stratify: list[str] | None = None,
    taxonomy: DataFrame | None = None,
    tree: Tree | None = None,
    enrich_with: tuple[str, ...] = (),
    overrides: dict | None = None,
    parallelism: int = 4,
    start_points: dict[str, list[dict]] | None = None,
    max_levels: int = ORDINAL_CAP,
) -> tuple[dict[str, TunedModel], DataFrame]:
    """The best model of each type. All types share the folds, the metric table and, where their data
    settings agree, the written design tables."""
    spark = ds.samples.sparkSession
    n_features, bounds = data_bounds(ds)
    table, tables = None, {}
    for kind in model_types:
        name = F.col("id").cast("string") if len(model_types) == 1 else F.concat(F.lit(f"{kind}-"), F.col("id").cast("string"))
        trials = spark.range(n_trials).select(name.alias("trial"))
        drawn = candidates(kind, trials, seed, n_features, bounds, overrides, taxonomy is not None, enrich_with)
        tables[kind] = with_start_points(drawn, (start_points or {}).get(kind, []))
        table = tables[kind] if table is None else table.unionByName(tables[kind], allowMissingColumns=True)
    fold_metrics = evaluate_candidates(
        ds, table, target, k, seed, group, stratify, taxonomy, tree, enrich_with, parallelism, max_levels=max_levels
    )
    chosen = {
        kind: _choose(ds, target, kind, tables[kind], fold_metrics, k, seed, taxonomy, tree, enrich_with, max_levels) for kind in model_types
    }
    return chosen, fold_metrics


def _choose(
    ds: Dataset, target: str, model_type: str, table: DataFrame, fold_metrics: DataFrame, k: int, seed: int,
    taxonomy: DataFrame | None, tree: Tree | None, enrich_with: tuple[str, ...], max_levels: int,
) -> TunedModel:
    metric, mode = SELECTION_METRIC[task_of(model_type)]
    scores = table.join(trial_scores(fold_metrics, metric), "trial")
    best = select_one_se(scores, metric, mode, model_type).first()
    if best is None:
        raise RuntimeError("No trial reported the selection metric.")
    row = best.asDict()
    rounds = None
    if "n_estimators" in row and model_type.startswith("gbt"):
        iters = fold_metrics.where("metric = 'best_iter'").withColumnRenamed("value", "best_iter")
        got = best_iteration(iters.where(F.col("trial") == row["trial"]), k, row["n_estimators"]).first()
        rounds = got["n_estimators"] if got else None
    return refit(ds, target, model_type, row, seed, taxonomy, tree, enrich_with, rounds, max_levels)


def contrast_rows(ds: Dataset, tree: Tree, target: str) -> DataFrame:
    """sample_id, pos, value, y: what a log contrast is fitted on, written."""
    if ds.n_prev:
        raise ValueError("log_contrast has no snapshots; leave it out for windowed data")
    cells = log_geom_cells(ds.samples, ds.abund, tree.matrix, tree.columns)
    return materialize(cells.join(_target(ds, target, "log_contrast")[0], "sample_id"))


def refit(
    ds: Dataset, target: str, kind: str, row: dict, seed: int = 0, taxonomy: DataFrame | None = None,
    tree: Tree | None = None, enrich_with: tuple[str, ...] = (), rounds: int | None = None, max_levels: int = ORDINAL_CAP,
    contrast: DataFrame | None = None,
) -> TunedModel:
    """Fit one candidate's engineering and model on all rows. ``contrast``: the rows of a log contrast, if they are written."""
    params = _params(row, kind)
    if rounds:
        params["n_estimators"] = rounds
    if kind == "log_contrast":
        x = contrast_rows(ds, tree, target) if contrast is None else contrast
        return TunedModel(fit_log_contrast(x, tree.n_leaves(), params["lambda"]), Config(), None, None, None, tree)
    y, classes = _target(ds, target, kind, max_levels)
    cfg = _config(row, enrich_with)
    frozen = fit_engineering(ds, cfg, taxonomy)
    x = apply_engineering(ds, frozen, taxonomy, [REFIT]).join(y, "sample_id")
    train = materialize(x).select(to_features(F.col("x"), kind).alias("features"), F.col("y").alias("label"))
    fitted = fit_model(kind, train, params, n_classes=len(classes) if classes else None, seed=seed)
    return TunedModel(fitted, cfg, frozen, classes, taxonomy)


def evaluate(models: dict[str, TunedModel], train: Dataset, test: Dataset, target: str) -> DataFrame:
    """Metrics of every model on both splits: (model, split, metric, value)."""
    parts = None
    for name, tm in models.items():
        preds = m.stack_predictions(tm.predict(train, target), tm.predict(test, target)).withColumn("model", F.lit(name))
        if tm.fitted.kind in CLASSIFIERS:
            table = m.classification_metrics(preds.withColumn("label", F.col("label").cast("string")), tm.classes)
        else:
            table = m.with_p_value(m.regression_metrics(preds)).drop("n")
        long = table.unpivot(["model", "split"], [c for c in table.columns if c not in ("model", "split")], "metric", "value")
        parts = long if parts is None else parts.unionByName(long)
    return parts


def explain(tm: TunedModel, rows: Dataset, train: Dataset, n_perm: int = 8, max_background: int | None = None, seed: int = 0) -> DataFrame:
    """What a fitted model rests on: the coefficients of models that have some; of tree models the exact Shapley values
    of ``rows`` against all of ``train``; else sampled ones (against ``max_background`` rows of it at most)."""
    if tm.fitted.kind in COEF_MODELS:
        return coefficients(rows.samples.sparkSession, tm.fitted, tm.names, tm.classes)
    if tm.fitted.kind in TREES:
        return tree_shapley(tm.fitted, tm.design(rows), tm.design(train), tm.names, tm.classes or ["prediction"])
    return shapley_sample(tm.fitted, tm.design(rows), tm.design(train), tm.names, tm.classes or ["prediction"], n_perm, max_background, seed)


# --- persistence --------------------------------------------------------------------------


def save_model(tm: TunedModel, path: str) -> None:
    """Frozen tables as parquet, MLlib stages, and the settings as JSON."""
    if tm.frozen is None and tm.tree is None:
        raise ValueError("nothing to save")
    spark = (tm.frozen.columns if tm.frozen is not None else tm.tree.matrix).sparkSession
    for name, stage in tm.fitted.stages.items():
        stage.write().overwrite().save(f"{path}/stages/{name}")
    info = {
        "kind": tm.fitted.kind, "meta": tm.fitted.meta, "stages": list(tm.fitted.stages), "classes": tm.classes,
        "config": {**{c: getattr(tm.config, c) for c in DATA_COLUMNS}, "enrich_with": list(tm.config.enrich_with)},
        "taxonomy": tm.taxonomy is not None, "frozen": tm.frozen is not None,
    }
    if tm.frozen is not None:
        tm.frozen.columns.write.mode("overwrite").parquet(f"{path}/columns")
        tm.frozen.targets.write.mode("overwrite").parquet(f"{path}/targets")
        info["levels"], info["n_prev"] = tm.frozen.levels, tm.frozen.n_prev
        if tm.taxonomy is not None:
            tm.taxonomy.write.mode("overwrite").parquet(f"{path}/taxonomy")
    else:
        tm.tree.matrix.write.mode("overwrite").parquet(f"{path}/matrix")
        tm.tree.columns.write.mode("overwrite").parquet(f"{path}/tree_columns")
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1).write.mode("overwrite").text(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> TunedModel:
    info = json.loads(spark.read.text(f"{path}/info").first()[0])
    stages = {n: PipelineModel.load(f"{path}/stages/{n}") for n in info["stages"]}
    fitted = Fitted(info["kind"], stages, info["meta"])
    cfg = Config(**{**info["config"], "enrich_with": tuple(info["config"]["enrich_with"])})
    if info["frozen"]:
        frozen = Frozen(
            cfg, spark.read.parquet(f"{path}/columns"), spark.read.parquet(f"{path}/targets"), info["levels"], info["n_prev"]
        )
        tax = spark.read.parquet(f"{path}/taxonomy") if info["taxonomy"] else None
        return TunedModel(fitted, cfg, frozen, info["classes"], tax)
    tree = Tree(spark.read.parquet(f"{path}/matrix"), spark.read.parquet(f"{path}/tree_columns"))
    return TunedModel(fitted, cfg, None, None, None, tree)
