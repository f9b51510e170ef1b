"""Taxonomy, tree, enrichment and fitted engineering on the baskets and the activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura import bindings as b
from closura.functions import rows, taxon
from closura.operators import enrich as enr
from closura.operators import snapshot as snap
from closura.operators import taxonomy as tx
from closura.operators import tree
from closura.operators.splits import assign_folds, split
from closura.oracle import rd, with_
from closura.plans import engineer as eng
from closura.queries import query


def _entity(rank: str) -> str:
    i = taxon.RANKS.index(rank) + 1
    p = rank[0]
    part = f"regexp_replace(trim(split_part(taxon, ';', {i})), '[\\[\\]]', '', 'g')"
    return f"(CASE WHEN {part} IN ('', '{p}__') THEN '{p}__unknown' ELSE {part} END)"


def _parented(rank: str) -> str:
    up = taxon.RANKS[taxon.RANKS.index(rank) - 1]
    return f"(CASE WHEN {_entity(rank)} = '{rank[0]}__unknown' THEN '{rank[0]}__unkn_' || {_entity(up)} ELSE {_entity(rank)} END)"


@query(
    "F11_tax_entity",
    with_(b.LINEAGE, select="SELECT feature_id, " + ", ".join(f"{_entity(r)} AS {r}" for r in ("class", "order", "family", "species")).replace(" AS order", ' AS "order"') + " FROM lineage"),
)
def _(spark, sf):
    cols = [taxon.tax_entity(F.col("taxon"), r).alias(r) for r in ("class", "order", "family", "species")]
    return b.supplier_lineage(spark, sf).select("feature_id", *cols)


@query(
    "F12_tax_label_with_parent",
    with_(b.LINEAGE, select=f"SELECT feature_id, {_parented('class')} AS class, {_parented('order')} AS ord, {_parented('species')} AS species FROM lineage"),
)
def _(spark, sf):
    lab = lambda r: taxon.tax_label_with_parent(F.col("taxon"), r)
    return b.supplier_lineage(spark, sf).select(
        "feature_id", lab("class").alias("class"), lab("order").alias("ord"), lab("species").alias("species")
    )


@query("F14_leaf_name", with_(b.LINEAGE, select="SELECT feature_id, taxon || '; otu__' || feature_id AS name FROM lineage"))
def _(spark, sf):
    return b.supplier_lineage(spark, sf).select("feature_id", taxon.leaf_name(F.col("taxon"), F.col("feature_id")).alias("name"))


@query("F15_stratum_label", "SELECT c_custkey::VARCHAR AS sample_id, c_mktsegment || '__§__' || c_nationkey::VARCHAR AS stratum FROM customer")
def _(spark, sf):
    return b.customers(spark, sf).select("sample_id", taxon.stratum_label(["segment", "nation"]).alias("stratum"))


_PART = "ptax AS (SELECT * FROM lineage WHERE substr(feature_id, 2)::BIGINT % 9 <> 0)"


def _partial_taxonomy(spark, sf):
    return b.supplier_lineage(spark, sf).where(F.col("feature_id").substr(2, 20).cast("bigint") % 9 != 0)


def _register_aggregation(rank: str) -> None:
    @query(
        f"A4_aggregate_by_{rank}",
        with_(b.PREPARED, b.LINEAGE, _PART, select=f"""SELECT sample_id, {_parented(rank)} AS feature_id, {rd('sum(value)')} AS value
  FROM abund JOIN ptax USING (feature_id) GROUP BY 1, 2"""),
    )
    def _(spark, sf):
        out = tx.aggregate_by_taxonomy(b.baskets(spark, sf), _partial_taxonomy(spark, sf), rank)
        return out.withColumn("value", F.round("value", 9))


for _rank in ("class", "order", "family", "genus"):
    _register_aggregation(_rank)


@query("J4_unmatched_features", with_(b.PREPARED, b.LINEAGE, _PART, select="SELECT DISTINCT feature_id FROM abund WHERE feature_id NOT IN (SELECT feature_id FROM ptax)"))
def _(spark, sf):
    return tx.unmatched_features(b.baskets(spark, sf), _partial_taxonomy(spark, sf))


_NORTH = "third AS (SELECT * FROM abund WHERE substr(feature_id, 2)::BIGINT % 3 = 0)"


@query("P10_align_taxonomy", with_(b.PREPARED, b.LINEAGE, _NORTH, select=f"SELECT feature_id, taxon, {rd('confidence')} AS confidence FROM lineage WHERE feature_id IN (SELECT feature_id FROM third)"))
def _(spark, sf):
    cells = b.baskets(spark, sf).where(F.col("feature_id").substr(2, 20).cast("bigint") % 3 == 0)
    return tx.align_taxonomy(b.supplier_lineage(spark, sf), cells).withColumn("confidence", F.round("confidence", 9))


# --- tree ---------------------------------------------------------------------------------

_CLOSURE = """anc AS (
  SELECT node AS tip, parent AS node FROM edges WHERE is_tip AND parent IN (SELECT node FROM edges)
  UNION ALL SELECT a.tip, e.parent FROM anc a JOIN edges e ON e.node = a.node WHERE e.parent IN (SELECT node FROM edges))"""
_MATRIX = """nl AS (SELECT node, count(*) AS n_leaves, string_agg(tip, ',' ORDER BY tip) AS sig FROM anc GROUP BY 1),
keep AS (SELECT node, n_leaves, ord AS node_ord FROM (SELECT nl.*, e.ord, row_number() OVER (PARTITION BY sig ORDER BY e.ord) AS r
         FROM nl JOIN edges e USING (node)) WHERE r = 1),
matrix AS (SELECT node AS tip, node, true AS is_tip, ord AS node_ord, 1::BIGINT AS n_leaves FROM edges WHERE is_tip
  UNION ALL SELECT tip, node, false, node_ord, n_leaves FROM anc JOIN keep USING (node))"""


@query("J6_tip_ancestors", with_(b.TREE, _CLOSURE, _MATRIX, select="SELECT * FROM matrix", recursive=True))
def _(spark, sf):
    return tree.tip_ancestors(b.supplier_tree(spark, sf))


_KEEP_TIPS = "f AS (SELECT 'F' || s_suppkey::VARCHAR AS feature_id FROM supplier WHERE s_suppkey % 3 = 0)"


@query(
    "P11_prune_tree",
    with_(
        b.TREE,
        _KEEP_TIPS,
        _CLOSURE.replace("WHERE is_tip AND parent", "WHERE is_tip AND node IN (SELECT feature_id FROM f) AND parent"),
        "live AS (SELECT DISTINCT node FROM anc UNION SELECT feature_id FROM f)",
        "forks AS (SELECT parent AS node FROM edges WHERE node IN (SELECT node FROM live) GROUP BY 1 HAVING count(*) > 1)",
        """up AS (SELECT node AS start, parent AS node, 1 AS d FROM edges
  UNION ALL SELECT u.start, e.parent, d + 1 FROM up u JOIN edges e ON e.node = u.node)""",
        """surv AS (SELECT node, is_tip, ord FROM edges WHERE node IN (SELECT node FROM live) AND (is_tip OR node IN (SELECT node FROM forks)))""",
        select="""SELECT s.node, coalesce((SELECT arg_min(u.node, u.d) FROM up u WHERE u.start = s.node AND u.node IN (SELECT node FROM surv)), 'root') AS parent,
  is_tip, ord FROM surv s""",
        recursive=True,
    ),
)
def _(spark, sf):
    keep = b.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("feature_id"))
    return tree.prune_tree(b.supplier_tree(spark, sf), keep)


@query(
    "F13_consensus_taxon",
    with_(
        b.TREE, b.LINEAGE, _CLOSURE, _MATRIX,
        "leaves AS (SELECT feature_id AS tip, taxon || '; otu__' || feature_id AS leaf FROM lineage)",
        "mm AS (SELECT node, node_ord, min(leaf) AS lo, max(leaf) AS hi FROM matrix JOIN leaves USING (tip) WHERE NOT is_tip GROUP BY 1, 2)",
        "pre AS (SELECT *, (SELECT coalesce(max(i), 0) FROM range(1, 400) t(i) WHERE i <= least(length(lo), length(hi)) AND substr(lo, 1, i) = substr(hi, 1, i)) AS n FROM mm)",
        "base AS (SELECT node, node_ord, CASE WHEN position(';' IN substr(lo, 1, n)) > 0 THEN regexp_replace(substr(lo, 1, n), ';[^;]*$', '') ELSE '' END AS base FROM pre)",
        select="""SELECT node, leaf AS name FROM matrix JOIN leaves USING (tip) WHERE is_tip
  UNION ALL SELECT node, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY node_ord) = 1 THEN base ELSE base || '; n__' || node_ord::VARCHAR END FROM base""",
        recursive=True,
    ),
)
def _(spark, sf):
    return tree.node_names(tree.tip_ancestors(b.supplier_tree(spark, sf)), b.supplier_lineage(spark, sf))


@query(
    "A26_log_geom",
    with_(
        b.PREPARED, b.TREE, _CLOSURE, _MATRIX,
        "ids AS (SELECT DISTINCT sample_id FROM abund)",
        """lg AS (SELECT i.sample_id, m.node, m.n_leaves, avg(ln(coalesce(a.value, 0) + 1e-9)) AS v
           FROM ids i CROSS JOIN matrix m LEFT JOIN abund a ON a.sample_id = i.sample_id AND a.feature_id = m.tip GROUP BY 1, 2, 3)""",
        select=f"SELECT sample_id, node, {rd('v')} AS log_mean FROM lg WHERE n_leaves > 1",
        recursive=True,
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    m = eng.materialize(tree.tip_ancestors(b.supplier_tree(spark, sf)))
    # only nodes of several leaves are asked for: rows as wide as these, not as all tips
    cols = eng.materialize(tree.inner_columns(tree.matrix_columns(m)))
    x = tree.log_geom(ds.samples, ds.abund, m, cols)
    return (
        x.select("sample_id", F.posexplode_outer("x").alias("col", "v"))
        .join(cols, "col")
        .select("sample_id", "node", F.round("v", 9).alias("log_mean"))
    )


# --- enrichment ---------------------------------------------------------------------------

_SHANNON = "sh AS (SELECT sample_id, -sum(value * ln(value + 1e-9)) AS h FROM abund GROUP BY 1)"


@query("F8_shannon", with_(b.PREPARED, _SHANNON, select=f"SELECT sample_id, {rd('h')} AS shannon_entropy FROM sh"))
def _(spark, sf):
    return enr.shannon(b.baskets(spark, sf)).withColumn(enr.SHANNON, F.round(enr.SHANNON, 9))


_DUMMIES = """lv AS (SELECT DISTINCT segment AS level FROM samples), lvr AS (SELECT level FROM lv WHERE level <> (SELECT min(level) FROM lv)),
onehot AS (SELECT sample_id, 'segment_' || level AS name, CASE WHEN segment = level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM samples CROSS JOIN lvr)"""


@query("F9_one_hot", with_(b.CELLS, b.ALIGNED, _DUMMIES, select="SELECT * FROM onehot"))
def _(spark, sf):
    samples = b.customers(spark, sf).join(b.basket_cells(spark, sf).select("sample_id").distinct(), "sample_id", "left_semi")
    levels = enr.category_levels(samples, ["segment"])["segment"]
    names = F.array(*[F.lit(f"segment_{v}") for v in levels[1:]])
    return samples.select("sample_id", F.posexplode_outer(rows.one_hot(F.col("segment"), levels)).alias("p", "value")).select(
        "sample_id", F.element_at(names, F.col("p") + 1).alias("name"), "value"
    )


_ENRICH = {
    "shannon": "SELECT sample_id, 'shannon_entropy' AS name, h AS value FROM sh",
    "metadata_only": "SELECT sample_id, name, value FROM onehot UNION ALL SELECT sample_id, 'acctbal', acctbal FROM samples",
}
_ENRICH["shannon_and_metadata"] = _ENRICH["shannon"] + " UNION ALL " + _ENRICH["metadata_only"]


def _register_enrich(mode: str) -> None:
    @query(
        f"F10_enrich_{mode}",
        with_(b.PREPARED, b.ALIGNED, _SHANNON, _DUMMIES, select=f"SELECT sample_id, name, {rd('value')} AS value FROM ({_ENRICH[mode]})"),
    )
    def _(spark, sf):
        ds = b.basket_dataset(spark, sf)
        return enr.enrich(ds.samples, ds.abund, mode, ["segment", "acctbal"]).withColumn("value", F.round("value", 9))


for _mode in _ENRICH:
    _register_enrich(_mode)


# --- fitted engineering -------------------------------------------------------------------


def long_design(x, names: list[str], *keep: str):
    labels = F.array(*[F.lit(n) for n in names])
    return x.select("sample_id", *keep, F.posexplode_outer("x").alias("p", "value")).select(
        "sample_id", *keep, F.get(labels, F.col("p")).alias("name"), rows.rounded(F.col("value"), 9).alias("value")
    )


def _frozen_sql(src: str, train: str, low: str, group: str) -> list[str]:
    """CTEs: per-feature statistics of ``src`` over the samples in ``train``, marks and frozen columns."""
    return [
        f"feats AS (SELECT DISTINCT feature_id FROM {src})",
        f"grid AS (SELECT i.sample_id, f.feature_id, coalesce(a.value, 0) AS value FROM ids i CROSS JOIN feats f LEFT JOIN {src} a ON a.sample_id = i.sample_id AND a.feature_id = f.feature_id)",
        f"fstats AS (SELECT feature_id, sum(value) AS abundance, var_samp(value) AS variance FROM grid WHERE sample_id IN ({train}) GROUP BY 1)",
        low,
        f"""g AS (SELECT count(*) >= 2 AS grouped FROM low),
frozen AS (SELECT feature_id, false AS is_group FROM fstats, g WHERE NOT (grouped AND feature_id IN (SELECT feature_id FROM low))
  UNION ALL SELECT '{group}', true FROM g WHERE grouped)""",
        f"sel AS (SELECT g.sample_id, coalesce(f.feature_id, '{group}') AS feature_id, sum(g.value) AS value FROM grid g LEFT JOIN frozen f USING (feature_id) GROUP BY 1, 2)",
        "eps AS (SELECT *, CASE WHEN value = 0 THEN 1e-9 ELSE value END AS v FROM sel)",
        "clr AS (SELECT sample_id, 'clr_' || feature_id AS name, ln(v) - avg(ln(v)) OVER (PARTITION BY sample_id) AS value FROM eps)",
    ]


_IDS = "ids AS (SELECT DISTINCT sample_id FROM abund)"
_CLASSED = f"classed AS (SELECT sample_id, {_parented('class')} AS feature_id, sum(value) AS value FROM abund JOIN lineage USING (feature_id) GROUP BY 1, 2)"
_TOP8 = "low AS (SELECT feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY abundance DESC, feature_id) AS r FROM fstats) WHERE r > 8)"


@query(
    "M1_engineer",
    with_(
        b.PREPARED, b.ALIGNED, b.LINEAGE, _IDS, _CLASSED, *_frozen_sql("classed", "SELECT sample_id FROM ids", _TOP8, "F_low_abun"), _SHANNON, _DUMMIES,
        select=f"SELECT sample_id, name, {rd('value')} AS value FROM (SELECT * FROM clr UNION ALL {_ENRICH['shannon_and_metadata']})",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    cfg = eng.Config("tax_class", "abundance_topi", i=8, transform="clr", enrich="shannon_and_metadata", enrich_with=("segment", "acctbal"))
    x, frozen = eng.engineer(ds, cfg, b.supplier_lineage(spark, sf))
    return long_design(x, eng.design_names(frozen))


_HASH = "('0x' || substr(md5('{seed}|' || {id}), 1, 8))::BIGINT"


def hash_sql(seed: int, ident: str) -> str:
    return _HASH.format(seed=seed, id=ident)


_SPLIT80 = f"""sp AS (SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY {hash_sql(7, 'sample_id')}, sample_id) <= floor(0.8 * count(*) OVER () + 1e-9)
  THEN 'train' ELSE 'test' END AS split FROM ids)"""


@query(
    "M2_engineer_split",
    with_(
        b.PREPARED, _IDS, _SPLIT80,
        *_frozen_sql("abund", "SELECT sample_id FROM sp WHERE split = 'train'", "low AS (SELECT feature_id FROM fstats WHERE variance < (SELECT quantile_cont(variance, 0.8) FROM fstats))", "F_low_var"),
        select=f"SELECT sample_id, split, name, {rd('value')} AS value FROM clr JOIN sp USING (sample_id)",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    splits = split(ds.samples.select("sample_id"), 0.8, 7)
    x, frozen = eng.engineer_split(ds, splits, eng.Config(selection="variance_quantile", q=0.8, transform="clr"))
    return long_design(x, eng.design_names(frozen), "split")


_K = 3
_FOLDED = f"fo AS (SELECT sample_id, (row_number() OVER (ORDER BY {hash_sql(11, 'sample_id')}, sample_id) - 1) % {_K} AS fold FROM ids)"


def _m3_sql(low: str, group: str, tail: str, cells: str = b.PREPARED) -> str:
    return with_(
        cells, _IDS, _FOLDED,
        "fits AS (SELECT unnest([0, 1, 2, -1]) AS fit)",
        "feats AS (SELECT DISTINCT feature_id FROM abund)",
        "grid AS (SELECT i.sample_id, fold, f.feature_id, coalesce(a.value, 0) AS value FROM fo i CROSS JOIN feats f LEFT JOIN abund a ON a.sample_id = i.sample_id AND a.feature_id = f.feature_id)",
        "fstats AS (SELECT fit, feature_id, sum(value) AS abundance, var_samp(value) AS variance FROM grid JOIN fits ON fold <> fit GROUP BY 1, 2)",
        low,
        "g AS (SELECT fit, count(*) >= 2 AS grouped FROM low GROUP BY 1)",
        f"""frozen AS (SELECT s.fit, s.feature_id, false AS is_group FROM fstats s LEFT JOIN g USING (fit) LEFT JOIN low l ON l.fit = s.fit AND l.feature_id = s.feature_id
              WHERE NOT (coalesce(grouped, false) AND l.feature_id IS NOT NULL)
            UNION ALL SELECT fit, '{group}', true FROM g WHERE grouped)""",
        f"""sel AS (SELECT t.fit, g.sample_id, g.fold, coalesce(f.feature_id, '{group}') AS feature_id, coalesce(f.is_group, true) AS is_group, sum(g.value) AS value
            FROM grid g CROSS JOIN fits t LEFT JOIN frozen f ON f.fit = t.fit AND f.feature_id = g.feature_id GROUP BY ALL)""",
        "eps AS (SELECT *, CASE WHEN value = 0 THEN 1e-9 ELSE value END AS v FROM sel)",
        select=tail,
    )


@query(
    "M3_engineer_folds_clr",
    _m3_sql(
        "low AS (SELECT fit, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY variance DESC, feature_id) AS r FROM fstats) WHERE r > 6)",
        "F_low_var",
        f"""SELECT sample_id, fit, CASE WHEN fold = fit THEN 'val' ELSE 'train' END AS split,
  (row_number() OVER (PARTITION BY fit, sample_id ORDER BY is_group, feature_id) - 1)::INTEGER AS pos,
  {rd('ln(v) - avg(ln(v)) OVER (PARTITION BY fit, sample_id)')} AS value FROM eps""",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    folds = assign_folds(ds.samples, _K, 11)
    x, _f = eng.engineer_folds(ds, folds, _K, eng.Config(selection="variance_topi", i=6, transform="clr"))
    return x.select("sample_id", "fit", "split", F.posexplode_outer("x").alias("pos", "value")).withColumn("value", F.round("value", 9))


@query(
    "M3_engineer_folds_alr",
    _m3_sql(
        """o AS (SELECT *, row_number() OVER w AS r, sum(abundance) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, count(*) OVER (PARTITION BY fit) AS n,
   sum(abundance) OVER (PARTITION BY fit) AS tot FROM fstats WINDOW w AS (PARTITION BY fit ORDER BY abundance, feature_id)),
edge AS (SELECT fit, abundance AS e FROM o WHERE r = n - 3 + 1),
low AS (SELECT fit, feature_id FROM o JOIN edge USING (fit) WHERE cum <= e AND tot > e)""",
        "F_low_abun",
        f"""SELECT sample_id, fit, split, pos, {rd('ln(v / dv)')} AS value FROM (
  SELECT e.sample_id, e.fit, CASE WHEN fold = e.fit THEN 'val' ELSE 'train' END AS split, v, dv,
    (row_number() OVER (PARTITION BY e.fit, e.sample_id ORDER BY is_group, feature_id) - 1)::INTEGER AS pos
  FROM eps e JOIN (SELECT fit, sample_id, feature_id AS dfeat, v AS dv FROM eps JOIN (
      SELECT fit, arg_min(feature_id, struct_pack(a := -cnt, b := is_group, c := feature_id)) AS dfeat FROM (
        SELECT fit, feature_id, is_group, count_if(value <> 0 AND fold <> fit) AS cnt FROM eps GROUP BY ALL) GROUP BY 1) USING (fit) WHERE feature_id = dfeat) d
    ON d.fit = e.fit AND d.sample_id = e.sample_id WHERE feature_id <> dfeat)""",
        b.SKEWED,
    ),
)
def _(spark, sf):
    ds = b.skewed_dataset(spark, sf)
    folds = assign_folds(ds.samples, _K, 11)
    x, _f = eng.engineer_folds(ds, folds, _K, eng.Config(selection="abundance_ith", i=3, transform="alr"))
    return x.select("sample_id", "fit", "split", F.posexplode_outer("x").alias("pos", "value")).withColumn("value", rows.rounded(F.ln("value"), 9))


@query(
    "M4_design_with_unseen_features",
    with_(
        b.PREPARED, _IDS,
        "known AS (SELECT * FROM abund WHERE substr(feature_id, 2)::BIGINT % 5 <> 0)",
        "kid AS (SELECT count(DISTINCT sample_id) AS n FROM abund)",
        "fstats AS (SELECT feature_id, sum(value) AS abundance FROM known GROUP BY 1)",
        "g AS (SELECT count(*) - 8 >= 2 AS grouped FROM fstats)",
        "kept AS (SELECT feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY abundance DESC, feature_id) AS r FROM fstats), g WHERE r <= 8 OR NOT grouped)",
        "names AS (SELECT feature_id AS name FROM kept UNION ALL SELECT 'F_low_abun' FROM g WHERE grouped)",
        "vals AS (SELECT sample_id, coalesce(k.feature_id, 'F_low_abun') AS name, sum(value) AS value FROM abund LEFT JOIN kept k USING (feature_id) GROUP BY 1, 2)",
        select=f"SELECT i.sample_id, n.name, {rd('coalesce(value, 0)')} AS value FROM ids i CROSS JOIN names n LEFT JOIN vals v ON v.sample_id = i.sample_id AND v.name = n.name",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    seen = F.col("feature_id").substr(2, 20).cast("bigint") % 5 != 0
    fit_on = ds.with_(abund=ds.abund.where(seen), features=ds.features.where(seen))
    frozen = eng.fit_engineering(fit_on, eng.Config(selection="abundance_topi", i=8))
    x, _f = eng.engineer(ds, frozen.config, frozen=frozen)
    return long_design(x, eng.design_names(frozen))


_TRANSFORMED = {
    "none": "SELECT sample_id, feature_id AS name, value FROM sel",
    "clr": "SELECT * FROM clr",
    "pa": "SELECT sample_id, 'pa_' || feature_id AS name, CASE WHEN value <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM sel",
    "rank": """SELECT sample_id, 'rank_' || feature_id AS name, r + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0::DOUBLE AS value
       FROM (SELECT *, rank() OVER (PARTITION BY sample_id ORDER BY value DESC) AS r FROM sel)""",
    "ilr": """SELECT sample_id, 'ilr_' || (pos - 1)::VARCHAR AS name, sqrt(pos / (pos + 1.0)) * (m - lv) AS value FROM (
       SELECT sample_id, ln(v) AS lv, row_number() OVER w - 1 AS pos, avg(ln(v)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
       FROM eps e JOIN frozen USING (feature_id) WINDOW w AS (PARTITION BY sample_id ORDER BY is_group, feature_id)) WHERE pos >= 1""",
}


def _register_transform(method: str) -> None:
    @query(
        f"F7_transform_{method}",
        with_(b.PREPARED, _IDS, *_frozen_sql("abund", "SELECT sample_id FROM ids", _TOP8, "F_low_abun"), select=f"SELECT sample_id, name, {rd('value')} AS value FROM ({_TRANSFORMED[method]})"),
    )
    def _(spark, sf):
        ds = b.basket_dataset(spark, sf)
        cfg = eng.Config(selection="abundance_topi", i=8, transform=None if method == "none" else method)
        x, frozen = eng.engineer(ds, cfg)
        return long_design(x, eng.design_names(frozen))


for _m in _TRANSFORMED:
    _register_transform(_m)


# --- snapshots ----------------------------------------------------------------------------

_WINDOWS = """links AS (SELECT s.sample_id, k AS t_off, s.host, s.time - k AS time, p.sample_id AS source_id, p.peak
  FROM asamples s CROSS JOIN range(0, 3) r(k) LEFT JOIN asamples p ON p.host = s.host AND p.time = s.time - k),
full_ids AS (SELECT sample_id FROM links GROUP BY 1 HAVING count(source_id) = 3)"""


def activity_windows(spark, sf, mode="nan", n_prev=2):
    samples, cells = b.activity_samples(spark, sf), b.activity_cells(spark, sf)
    from closura.operators.prepare import prepare_features

    return snap.snapshot_windows(samples, prepare_features(cells), "host", "time", n_prev, mode)


@query("J2_windows_nan", with_(b.ACTIVITY, _WINDOWS, select="SELECT sample_id, t_off::INTEGER AS t_off, host, time::INTEGER AS time, peak, source_id IS NOT NULL AS present FROM links"))
def _(spark, sf):
    return activity_windows(spark, sf).samples


@query("J2_windows_exclude", with_(b.ACTIVITY, _WINDOWS, select="SELECT sample_id, t_off::INTEGER AS t_off, host, time::INTEGER AS time, peak, true AS present FROM links WHERE sample_id IN (SELECT sample_id FROM full_ids)"))
def _(spark, sf):
    return activity_windows(spark, sf, "exclude").samples


_WCELLS = "wcells AS (SELECT l.sample_id, l.t_off::INTEGER AS t_off, feature_id, value FROM links l JOIN aprep a ON a.sample_id = l.source_id)"


@query("J2_window_cells", with_(b.ACTIVITY, _WINDOWS, _WCELLS, select=f"SELECT sample_id, t_off, feature_id, {rd('value')} AS value FROM wcells"))
def _(spark, sf):
    return activity_windows(spark, sf).abund.withColumn("value", F.round("value", 9))


@query("P7_snapshot", with_(b.ACTIVITY, _WINDOWS, _WCELLS, select=f"SELECT sample_id, t_off, feature_id, {rd('value')} AS value FROM wcells WHERE t_off = 1"))
def _(spark, sf):
    return snap.snapshot(activity_windows(spark, sf), 1).abund.withColumn("value", F.round("value", 9))


@query("P8_time_labels", with_(b.ACTIVITY, _WINDOWS, _WCELLS, select="SELECT DISTINCT t_off, CASE WHEN t_off = 0 THEN 't0' ELSE 't-' || t_off::VARCHAR END AS label FROM wcells"))
def _(spark, sf):
    return snap.time_labels(activity_windows(spark, sf).abund)


_EVENT_FEATURES = ("Fclick", "Ferror", "Fpurchase", "Fsignup", "Fview")


@query(
    "P9_to_wide",
    with_(
        b.ACTIVITY, _WINDOWS, _WCELLS,
        select="SELECT s.sample_id, s.host, s.time, s.peak, s.host AS \"host__t-1\", coalesce(l1.time, s.time - 1) AS \"time__t-1\", l1.peak AS \"peak__t-1\", "
        + ", ".join(
            f"""(SELECT CASE WHEN max(l.source_id) IS NULL THEN NULL ELSE {rd(f"coalesce(max(CASE WHEN w.feature_id = '{f}' THEN w.value END), 0)")} END FROM links l
    LEFT JOIN wcells w ON w.sample_id = l.sample_id AND w.t_off = l.t_off WHERE l.sample_id = s.sample_id AND l.t_off = {k}) AS "{f}{'' if k == 0 else f'__t-{k}'}" """
            for k in range(2)
            for f in _EVENT_FEATURES
        )
        + " FROM asamples s JOIN links l0 ON l0.sample_id = s.sample_id AND l0.t_off = 1 LEFT JOIN asamples l1 ON l1.sample_id = l0.source_id",
    ),
)
def _(spark, sf):
    wide = snap.to_wide(activity_windows(spark, sf, n_prev=1), ["host", "time", "peak"])
    cells = {f"{f}{k}" for k in ("", "__t-1") for f in _EVENT_FEATURES}
    return wide.select(*[F.round(F.col(f"`{c}`"), 9).alias(c) if c in cells else F.col(f"`{c}`") for c in wide.columns])


@query("P12_missing_rows", with_(b.ACTIVITY, _WINDOWS, select="SELECT sample_id FROM links WHERE t_off = 2 AND source_id IS NULL"))
def _(spark, sf):
    return snap.missing_rows(activity_windows(spark, sf), 2)


@query(
    "U2_restore_missing",
    with_(b.ACTIVITY, _WINDOWS, _WCELLS, select=f"""SELECT l.sample_id, {rd('h')} AS shannon_entropy FROM links l LEFT JOIN (
  SELECT sample_id, -sum(value * ln(value + 1e-9)) AS h FROM wcells WHERE t_off = 1 GROUP BY 1) USING (sample_id) WHERE l.t_off = 1"""),
)
def _(spark, sf):
    ds = activity_windows(spark, sf)
    return snap.restore_missing(enr.shannon(ds.abund.where("t_off = 1")), ds, 1).withColumn(enr.SHANNON, F.round(enr.SHANNON, 9))


@query(
    "W1_last_per_time",
    """SELECT user_id::VARCHAR AS host, time::INTEGER AS time, event_id::VARCHAR AS sample_id FROM (
  SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS time, row_number() OVER (PARTITION BY user_id, date_diff('day', DATE '2024-01-01', ts::DATE)
    ORDER BY ts DESC, event_id::VARCHAR DESC) AS r FROM events) WHERE r = 1""",
)
def _(spark, sf):
    ev = b.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("sample_id"), F.col("user_id").cast("string").alias("host"),
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("time"), "ts",
    )
    return snap.last_per_time(ev, "host", "time", "ts")


@query(
    "J3_merge_snapshots",
    with_(b.ACTIVITY, select=f"""SELECT sample_id, feature_id, 0 AS t_off, {rd('value')} AS value FROM aprep
  UNION ALL SELECT sample_id, feature_id, 1, value FROM acells"""),
)
def _(spark, sf):
    samples, cells = b.activity_samples(spark, sf), b.activity_cells(spark, sf)
    from closura.operators.prepare import prepare_features, prefix_features

    shares = prepare_features(cells)
    counts = cells
    return snap.merge_snapshots([(samples, shares), (samples, counts)], [shares, prefix_features(counts)]).abund.withColumn("value", F.round("value", 9))


@query(
    "J8_snapshot_design",
    with_(
        b.ACTIVITY, _WINDOWS, _WCELLS,
        "feats AS (SELECT DISTINCT feature_id FROM aprep)",
        """cellsg AS (SELECT l.sample_id, l.t_off, f.feature_id, l.source_id IS NOT NULL AS here, coalesce(w.value, 0) AS value FROM links l CROSS JOIN feats f
          LEFT JOIN wcells w ON w.sample_id = l.sample_id AND w.t_off = l.t_off AND w.feature_id = f.feature_id WHERE l.t_off < 2)""",
        """c AS (SELECT *, CASE WHEN value = 0 THEN 1e-9 ELSE value END AS v FROM cellsg)""",
        """d AS (SELECT sample_id, 'clr_' || feature_id || CASE WHEN t_off = 0 THEN '' ELSE '__t-' || t_off::VARCHAR END AS name, here,
             ln(v) - avg(ln(v)) OVER (PARTITION BY sample_id, t_off) AS value FROM c
          UNION ALL SELECT sample_id, 'shannon_entropy' || CASE WHEN t_off = 0 THEN '' ELSE '__t-' || t_off::VARCHAR END, bool_and(here), -sum(value * ln(value + 1e-9)) FROM cellsg GROUP BY sample_id, t_off
          UNION ALL SELECT sample_id, 'peak' || CASE WHEN t_off = 0 THEN '' ELSE '__t-' || t_off::VARCHAR END, source_id IS NOT NULL, peak FROM links WHERE t_off < 2)""",
        select=f"SELECT sample_id, name, CASE WHEN here THEN {rd('value')} ELSE 'NaN'::DOUBLE END AS value FROM d",
    ),
)
def _(spark, sf):
    ds = activity_windows(spark, sf, n_prev=1)
    x, frozen = eng.engineer(ds, eng.Config(transform="clr", enrich="shannon_and_metadata", enrich_with=("peak",)))
    return long_design(x, eng.design_names(frozen))
