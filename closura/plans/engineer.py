"""Fit and apply feature engineering: aggregate, select, transform, enrich.

One fit may cover K folds at once. The statistics a fit needs (counts, sums, second
moments) merge, so the table is read once: per-fold partials are combined into the K
"all but this fold" statistics plus one over all rows (fit -1, the refit).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.dataset import PSEUDOCOUNT, Dataset, suffixed
from closura.functions import rows
from closura.operators import enrich as enr
from closura.operators.select import clamp_i, freeze, group_feature, mark_low
from closura.operators.stats import merge_moments, partial_moments, variance_with_zeros
from closura.operators.taxonomy import aggregate_by_label, aggregate_features, aggregate_universe, labels_for
from closura.session import materialize

REFIT = -1
# Transforms.
TRANSFORMS = (None, "clr", "ilr", "alr", "pa", "rank")


@dataclass(frozen=True)
class Config:
    aggregation: str | None = None
    selection: str | None = None
    i: int | None = None
    q: float | None = None
    t: float | None = None
    transform: str | None = None
    enrich: str | None = None
    enrich_with: tuple[str, ...] = ()

    def __post_init__(self):
        if self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {self.transform!r}")
        enr.metadata_columns(self.enrich, list(self.enrich_with))


@dataclass(frozen=True)
class Frozen:
    """What a fit learned.

    columns  fit, t_off, pos, feature_id, is_group, is_denom, n_selected
    targets  fit, t_off, feature_id, pos, is_group: where each known feature goes
    levels   category levels of the enrichment columns
    """

    config: Config
    columns: DataFrame
    targets: DataFrame
    levels: dict[str, list[str]] = field(default_factory=dict)
    n_prev: int = 0

    def shape(self) -> dict[tuple[int, int], dict]:
        """Per (fit, t_off): n_selected, group position, denominator position. A handful of rows."""
        got = self.columns.groupBy("fit", "t_off").agg(
            F.max("n_selected").alias("n"),
            F.max(F.when(F.col("is_group"), F.col("pos"))).alias("group"),
            F.max(F.when(F.col("is_denom"), F.col("pos"))).alias("denom"),
        )
        return {(r["fit"], r["t_off"]): {"n": r["n"], "group": r["group"], "denom": r["denom"]} for r in got.collect()}


def dense_rows(sample_ids: DataFrame, abund: DataFrame, frozen: DataFrame) -> DataFrame:
    """One dense row per sample for a single fit without history."""
    from closura.operators.select import apply_selection

    width = frozen.count()
    packed = (
        apply_selection(abund, frozen)
        .groupBy("sample_id")
        .agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "value")).alias("e"))
    )
    sparse = sample_ids.join(packed, "sample_id", "left").select("sample_id", rows.sorted_entries(F.col("e")).alias("e"))
    return sparse.select("sample_id", rows.lay_out(F.col("e"), F.lit(width)).alias("x"))


def _lookup(values: dict[tuple[int, int], object], t_off: int, dtype: str) -> Column:
    """A literal per fit for one snapshot."""
    out = F.lit(None).cast(dtype)
    for (fit, off), v in values.items():
        if off == t_off and v is not None:
            out = F.when(F.col("fit") == fit, F.lit(v).cast(dtype)).otherwise(out)
    return out


def aggregate_cells(ds: Dataset, config: Config, taxonomy: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Cells and column universe after taxonomic aggregation, written once for fit and apply."""
    labels = labels_for(config.aggregation, taxonomy)
    cells = ds.abund if labels is None else materialize(aggregate_by_label(ds.abund, labels))
    return cells, materialize(aggregate_universe(ds.features, labels))


def _fits(folds: DataFrame | None, n_folds: int) -> list[int]:
    return [*range(n_folds), REFIT] if folds is not None else [REFIT]


def fold_statistics(ds: Dataset, aggregated: tuple[DataFrame, DataFrame], folds: DataFrame | None = None, n_folds: int = 0) -> DataFrame:
    """fit, t_off, feature_id, n1, abundance, variance, written: all that any selection asks of the cells. Configurations that
    share their aggregation share it."""
    spark, fits = ds.samples.sparkSession, _fits(folds, n_folds)
    cells, universe = aggregated
    present = ds.samples.where("present").select("sample_id", "t_off")
    if folds is None:
        cells = cells.withColumn("fold", F.lit(0))
        present = present.withColumn("fold", F.lit(0))
    else:
        cells = cells.join(folds.select("sample_id", "fold"), "sample_id")
        present = present.join(folds.select("sample_id", "fold"), "sample_id")
    not_own = F.filter(F.array(*[F.lit(f) for f in fits]), lambda f: f != F.col("fold"))
    merged = (
        partial_moments(cells, ["fold", "t_off", "feature_id"])
        .select(F.explode(not_own).alias("fit"), "t_off", "feature_id", F.struct("n1", "total", "mean", "m2").alias("p"))
        .groupBy("fit", "t_off", "feature_id")
        .agg(merge_moments(F.collect_list("p")).alias("s"))
        .select("fit", "t_off", "feature_id", "s.*")
    )
    sizes = {(r["fold"], r["t_off"]): r["n"] for r in present.groupBy("fold", "t_off").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_rows = spark.createDataFrame(
        [(f, o, sum(n for (fold, off), n in sizes.items() if off == o and fold != f)) for f in fits for o in ds.offsets],
        "fit int, t_off int, n_rows bigint",
    )
    every = universe.select(
        "feature_id",
        F.explode(F.array(*[F.lit(f) for f in fits])).alias("fit"),
        F.lit(list(ds.offsets)).alias("_o"),
    ).select("feature_id", "fit", F.explode("_o").alias("t_off"))
    stats = (
        every.join(merged, ["fit", "t_off", "feature_id"], "left")
        .na.fill(0.0, ["total", "mean", "m2"])
        .na.fill(0, ["n1"])
        .join(n_rows, ["fit", "t_off"])
        .select(
            "fit", "t_off", "feature_id", "n1", F.col("total").alias("abundance"),
            F.coalesce(variance_with_zeros(F.col("n_rows")), F.lit(0.0)).alias("variance"),
        )
    )
    return materialize(stats)


def fit_engineering(
    ds: Dataset,
    config: Config,
    taxonomy: DataFrame | None = None,
    folds: DataFrame | None = None,
    n_folds: int = 0,
    aggregated: tuple[DataFrame, DataFrame] | None = None,
    stats: DataFrame | None = None,
) -> Frozen:
    """Learn selection, denominator and category levels; with ``folds`` (sample_id, fold), for
    every fold's complement and for all rows. ``aggregated``: from ``aggregate_cells``, ``stats``: from ``fold_statistics``."""
    fits = _fits(folds, n_folds)
    levels = enr.category_levels(ds.samples, enr.metadata_columns(config.enrich, list(config.enrich_with)))
    cells, universe = aggregated or aggregate_cells(ds, config, taxonomy)
    stats = fold_statistics(ds, (cells, universe), folds, n_folds) if stats is None else stats
    cells = cells.withColumn("fold", F.lit(0)) if folds is None else cells.join(folds.select("sample_id", "fold"), "sample_id")
    keys = ["fit", "t_off"]
    if config.selection is None:
        marked = stats.withColumn("is_low", F.lit(False))
    else:
        i = config.i
        if i is not None:
            i = clamp_i(i, universe.count())
        marked = mark_low(stats, config.selection, keys, i=i, q=config.q, t=config.t)
    frozen = freeze(marked, group_feature(config.selection), keys)
    if config.transform == "alr":
        frozen = _mark_denominator(frozen, marked, cells, fits)
    else:
        frozen = frozen.withColumn("is_denom", F.lit(False))
    columns = materialize(frozen)
    kept = columns.where("not is_group").select("fit", "t_off", "feature_id", "pos", "is_group")
    groups = columns.where("is_group").select("fit", "t_off", "pos", "is_group")
    low = marked.where("is_low").select("fit", "t_off", "feature_id").join(groups, keys)
    targets = kept.unionByName(low.select(*kept.columns))
    return Frozen(config, columns, materialize(targets), levels, ds.n_prev)


def _mark_denominator(frozen: DataFrame, marked: DataFrame, cells: DataFrame, fits: list[int]) -> DataFrame:
    """Flag, per fit, the first selected column with most non-zero rows.

    A kept column's count is in the statistics. The group's count is the number of samples
    with any low feature, which needs one more pass over the low cells.
    """
    keys = ["fit", "t_off"]
    low = marked.where("is_low").select(*keys, "feature_id").join(frozen.where("is_group").select(*keys), keys)
    not_own = F.filter(F.array(*[F.lit(f) for f in fits]), lambda f: f != F.col("fold"))
    group_counts = (
        cells.where("value <> 0")
        .select("sample_id", "t_off", "feature_id", F.explode(not_own).alias("fit"))
        .join(low, ["fit", "t_off", "feature_id"], "left_semi")
        .select("fit", "t_off", "sample_id")
        .distinct()
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_group_cnt"))
    )
    counted = (
        frozen.join(marked.select(*keys, "feature_id", "n1"), [*keys, "feature_id"], "left")
        .join(group_counts, keys, "left")
        .withColumn("_cnt", F.coalesce(F.when(F.col("is_group"), F.col("_group_cnt")).otherwise(F.col("n1")), F.lit(0)))
    )
    best = counted.groupBy(*keys).agg(F.max_by("pos", F.struct("_cnt", -F.col("pos"))).alias("_d"), F.max("_cnt").alias("_top"))
    best = best.withColumn(
        "_d", F.when(F.col("_top") > 0, F.col("_d")).otherwise(F.raise_error(F.lit("all features are zero: no denominator")).cast("int"))
    )
    return counted.join(best, keys).withColumn("is_denom", F.col("pos") == F.col("_d")).select(*frozen.columns, "is_denom")


def transform_dense(x: Column, method: str | None, width: Column, denom: Column | None = None) -> Column:
    """The transform dispatcher: a single column is left alone; clr, ilr, alr get pseudocounts."""
    if method is None:
        return x
    filled = rows.pseudocount(x)
    done = {
        "clr": lambda: rows.clr(filled),
        "ilr": lambda: rows.ilr(filled),
        "alr": lambda: rows.alr(filled, denom),
        "pa": lambda: rows.presence_absence(x),
        "rank": lambda: rows.rank_row(x),
    }[method]()
    return F.when(width == 1, x).otherwise(done)


def transform_sparse(s: Column, method: str | None, width: Column, denom: Column | None = None) -> Column:
    """As ``transform_dense`` of the rows that ``s`` lays out (a plain column of sorted entries). Cells without an entry share
    one value in clr and alr, which is worked out once for the row."""
    x = rows.lay_out(s, width)
    if method not in ("clr", "alr"):
        return transform_dense(x, method, width, denom)
    eps = F.lit(PSEUDOCOUNT)
    entry = lambda pos, value: F.struct(pos.cast("int").alias("pos"), value.alias("value"))
    filled = F.transform(s, lambda e: entry(e["pos"], F.when(e["value"] == 0, eps).otherwise(e["value"])))
    if method == "clr":
        logs = F.transform(filled, lambda e: entry(e["pos"], F.ln(e["value"])))
        mean = lambda r: (rows.array_sum(F.transform(r, lambda e: e["value"])) + (width - F.size(r)) * F.ln(eps)) / width
        at = lambda r, m: rows.let(F.transform(r, lambda e: entry(e["pos"], e["value"] - m)), lambda c: rows.lay_out(c, width, F.ln(eps) - m))
        done = rows.let(logs, lambda r: rows.let(mean(r), lambda m: at(r, m)))
    else:
        below = lambda r: F.coalesce(F.get(F.filter(r, lambda e: e["pos"] == denom), F.lit(0))["value"], eps)
        place = lambda e: e["pos"] - (e["pos"] > denom).cast("int")
        ratios = lambda r, v: F.transform(F.filter(r, lambda e: e["pos"] != denom), lambda e: entry(place(e), e["value"] / v))
        done = rows.let(filled, lambda r: rows.let(below(r), lambda v: rows.let(ratios(r, v), lambda c: rows.lay_out(c, width - 1, eps / v))))
    return F.when(width == 1, x).otherwise(done)


def _out_width(config: Config, n: int) -> int:
    return n - 1 if config.transform in ("ilr", "alr") and n > 1 else n


def apply_engineering(
    ds: Dataset,
    frozen: Frozen,
    taxonomy: DataFrame | None = None,
    fits: list[int] | None = None,
    shape: dict | None = None,
    aggregated: tuple[DataFrame, DataFrame] | None = None,
    beside: DataFrame | None = None,
) -> DataFrame:
    """sample_id, fit, x: the design rows of every sample under each requested fit. Of ``beside`` (sample_id and more) the
    samples it names are taken and its columns kept; it is met before rows are laid out, so that wide rows are never shuffled.

    Features unseen at fit join the fit's group if there is one. Samples without a past
    snapshot get NaN in that snapshot's columns.
    """
    cfg = frozen.config
    shape = shape or frozen.shape()
    known = sorted({f for f, _ in shape})
    fits = known if fits is None else [f for f in fits if f in known]
    shape = {k: v for k, v in shape.items() if k[0] in fits}
    cells = aggregated[0] if aggregated else aggregate_features(ds.abund, cfg.aggregation, taxonomy)
    wanted = frozen.targets.where(F.col("fit").isin(fits))
    targets = wanted.groupBy("t_off", "feature_id").agg(F.collect_list(F.struct("fit", "pos", "is_group")).alias("to"))
    to_type = "array<struct<fit:int,pos:int,is_group:boolean>>"
    unseen = F.array().cast(to_type)
    for off in ds.offsets:
        here = [(f, s["group"]) for (f, o), s in shape.items() if o == off and s["group"] is not None]
        if here:
            item = [F.struct(F.lit(f).alias("fit"), F.lit(g).alias("pos"), F.lit(True).alias("is_group")) for f, g in here]
            unseen = F.when(F.col("t_off") == off, F.array(*item).cast(to_type)).otherwise(unseen)
    placed = (
        cells.join(targets, ["t_off", "feature_id"], "left")
        .select("sample_id", "t_off", "value", F.explode(F.coalesce(F.col("to").cast(to_type), unseen)).alias("to"))
        .select("sample_id", "t_off", "value", "to.*")
    )
    aggs = []
    for off in ds.offsets:
        mine = F.col("t_off") == off
        single = mine & ~F.col("is_group")
        aggs += [
            F.collect_list(F.when(single, F.struct("pos", "value"))).alias(f"e{off}"),
            F.sum(F.when(mine & F.col("is_group"), F.col("value"))).alias(f"g{off}"),
        ]
    packed = placed.groupBy("sample_id", "fit").agg(*aggs)
    kept = [] if beside is None else [c for c in beside.columns if c != "sample_id"]
    base = _sample_rows(ds, frozen)
    if beside is not None:
        base = base.join(beside, "sample_id")
    base = base.withColumn("fit", F.explode(F.array(*[F.lit(f) for f in fits])))
    joined = base.join(packed, ["sample_id", "fit"], "left")
    # sorted entries are a column of their own: the layout reads them once per entry
    for off in ds.offsets:
        group = _lookup({k: v["group"] for k, v in shape.items()}, off, "int")
        joined = joined.withColumn(f"s{off}", _entries(off, group))
    return joined.select("sample_id", "fit", *kept, _assemble(ds.offsets, cfg, shape).alias("x"))


def _entries(off: int, group: Column) -> Column:
    """Kept cells plus the group's sum, sorted by position."""
    sparse = "array<struct<pos:int,value:double>>"
    grouped = F.when(
        F.col(f"g{off}").isNotNull(), F.array(F.struct(group.alias("pos"), F.col(f"g{off}").alias("value")))
    ).otherwise(F.array().cast(sparse))
    return rows.sorted_entries(F.concat(F.coalesce(F.col(f"e{off}"), F.array()).cast(sparse), grouped.cast(sparse)))


def _assemble(offsets: list[int], cfg: Config, shape: dict) -> Column:
    """Concatenate the transformed blocks of all snapshots, then their enrichment blocks."""
    nan = F.lit(float("nan"))
    micro, other = [], []
    for off in offsets:
        width = _lookup({k: v["n"] for k, v in shape.items()}, off, "int")
        denom = _lookup({k: v["denom"] for k, v in shape.items()}, off, "int")
        out_width = _lookup({k: _out_width(cfg, v["n"]) for k, v in shape.items()}, off, "int")
        x = transform_sparse(F.col(f"s{off}"), cfg.transform, width, denom)
        here = F.coalesce(F.col(f"here{off}"), F.lit(False))
        micro.append(F.when(here, x).otherwise(F.array_repeat(nan, out_width)))
        o = F.col(f"o{off}")
        other.append(F.when(here, o).otherwise(F.transform(o, lambda _: nan)))
    return F.concat(*micro, *other)


def _sample_rows(ds: Dataset, frozen: Frozen) -> DataFrame:
    """One row per sample: presence and the enrichment block of each snapshot."""
    cfg = frozen.config
    md = enr.metadata_columns(cfg.enrich, list(cfg.enrich_with))
    block = enr.metadata_block(ds.samples, md, frozen.levels)
    if ds.n_prev == 0:
        base = ds.samples.select("sample_id", F.col("present").alias("here0"), block.alias("o0"))
    else:
        long = ds.samples.select("sample_id", "t_off", "present", block.alias("o"))
        aggs = []
        for off in ds.offsets:
            mine = F.col("t_off") == off
            aggs += [F.max(F.when(mine, F.col("present"))).alias(f"here{off}"), F.max(F.when(mine, F.col("o"))).alias(f"o{off}")]
        base = long.groupBy("sample_id").agg(*aggs)
    if enr.uses_shannon(cfg.enrich):
        term = enr.shannon_term(F.col("value"))
        h = ds.abund.groupBy("sample_id").agg(*[F.sum(F.when(F.col("t_off") == o, term)).alias(f"h{o}") for o in ds.offsets])
        base = base.join(h, "sample_id", "left")
        for o in ds.offsets:
            base = base.withColumn(f"o{o}", F.concat(F.array(F.coalesce(f"h{o}", F.lit(0.0))), f"o{o}")).drop(f"h{o}")
    return base


def design_names(frozen: Frozen, fit: int = REFIT) -> list[str]:
    """Column names of one fit's design rows (as many as a row is wide)."""
    cfg = frozen.config
    chosen: dict[int, list[str]] = {o: [] for o in range(frozen.n_prev + 1)}
    denom: dict[int, int] = {}
    for r in frozen.columns.where(F.col("fit") == fit).orderBy("t_off", "pos").collect():
        if r["is_denom"]:
            denom[r["t_off"]] = r["pos"]
        chosen[r["t_off"]].append(r["feature_id"])
    names = []
    for off, cols in chosen.items():
        if cfg.transform is None or len(cols) == 1:
            block = cols
        elif cfg.transform == "ilr":
            block = [f"ilr_{j}" for j in range(len(cols) - 1)]
        else:
            block = [f"{cfg.transform}_{c}" for j, c in enumerate(cols) if not (cfg.transform == "alr" and j == denom.get(off))]
        names += [suffixed(c, off) for c in block]
    md = enr.metadata_columns(cfg.enrich, list(cfg.enrich_with))
    extra = ([enr.SHANNON] if enr.uses_shannon(cfg.enrich) else []) + enr.metadata_names(md, frozen.levels)
    return names + [suffixed(c, off) for off in chosen for c in extra]


def subset(ds: Dataset, ids: DataFrame) -> Dataset:
    """The rows of some samples under the full column universe."""
    keep = ids.select("sample_id").distinct()
    return ds.with_(
        samples=ds.samples.join(keep, "sample_id", "left_semi"), abund=ds.abund.join(keep, "sample_id", "left_semi")
    )


def engineer(
    ds: Dataset, config: Config, taxonomy: DataFrame | None = None, frozen: Frozen | None = None
) -> tuple[DataFrame, Frozen]:
    """Fit (unless ``frozen`` is given) and apply on the same dataset."""
    aggregated = aggregate_cells(ds, config, taxonomy)
    frozen = frozen or fit_engineering(ds, config, taxonomy, aggregated=aggregated)
    return apply_engineering(ds, frozen, taxonomy, [REFIT], aggregated=aggregated).drop("fit"), frozen


def engineer_split(
    ds: Dataset, splits: DataFrame, config: Config, taxonomy: DataFrame | None = None
) -> tuple[DataFrame, Frozen]:
    """Fit on rows with split = 'train', apply to all: (sample_id, split, x)."""
    splits = materialize(splits.select("sample_id", "split"))
    frozen = fit_engineering(subset(ds, splits.where("split = 'train'")), config, taxonomy)
    # category levels come from all rows, so both parts share the same indicator columns
    md = enr.metadata_columns(config.enrich, list(config.enrich_with))
    frozen = Frozen(config, frozen.columns, frozen.targets, enr.category_levels(ds.samples, md), ds.n_prev)
    x = apply_engineering(ds, frozen, taxonomy, [REFIT], beside=splits)
    return x.select("sample_id", "x", "split"), frozen


def engineer_folds(
    ds: Dataset,
    folds: DataFrame,
    n_folds: int,
    config: Config,
    taxonomy: DataFrame | None = None,
    fits: list[int] | None = None,
    shared: dict | None = None,
) -> tuple[DataFrame, Frozen]:
    """Leak-free engineering of K folds plus the refit: (sample_id, fit, split, x). ``shared`` keeps what configurations of the
    same dataset and folds have in common between calls, by aggregation."""
    shared = {} if shared is None else shared
    if config.aggregation not in shared:
        folds = materialize(folds.select("sample_id", "fold"))
        aggregated = aggregate_cells(ds, config, taxonomy)
        shared[config.aggregation] = folds, aggregated, fold_statistics(ds, aggregated, folds, n_folds)
    folds, aggregated, stats = shared[config.aggregation]
    frozen = fit_engineering(ds, config, taxonomy, folds, n_folds, aggregated, stats)
    x = apply_engineering(ds, frozen, taxonomy, fits, aggregated=aggregated, beside=folds)
    split = F.when(F.col("fold") == F.col("fit"), "val").otherwise("train")
    return x.select("sample_id", "fit", split.alias("split"), "x"), frozen
