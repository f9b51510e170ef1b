"""Preparation, per-feature statistics and selection on the baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura import bindings as b
from closura.functions import rows
from closura.operators import prepare as prep
from closura.operators import select as sel
from closura.operators import stats
from closura.oracle import rd, with_
from closura.plans.engineer import dense_rows
from closura.queries import query


def _r(name, digits=9):
    return F.round(F.col(name), digits).alias(name)


@query("P1_prefix_features", with_(b.CELLS, select="SELECT sample_id, 'F' || feature_id AS feature_id, value FROM cells"))
def _(spark, sf):
    return prep.prefix_features(b.basket_cells(spark, sf))


@query(
    "P2_drop_zero_features",
    with_(
        b.CELLS_ZERO,
        select="SELECT * FROM zcells WHERE feature_id IN (SELECT feature_id FROM zcells GROUP BY 1 HAVING sum(value) <> 0)",
    ),
)
def _(spark, sf):
    return prep.drop_zero_features(b.basket_cells_with_zeros(spark, sf))


@query(
    "P2_zero_features_reported",
    with_(b.CELLS_ZERO, select="SELECT feature_id FROM zcells GROUP BY 1 HAVING sum(value) = 0"),
)
def _(spark, sf):
    return prep.zero_features(b.basket_cells_with_zeros(spark, sf))


@query(
    "P3_is_relative",
    with_(
        b.PREPARED,
        select="""SELECT 'raw' AS which, bool_and(round(t, 3) = 1) AS is_relative FROM (SELECT sum(value) t FROM cells GROUP BY sample_id)
  UNION ALL SELECT 'closed', bool_and(round(t, 3) = 1) FROM (SELECT sum(value) t FROM abund GROUP BY sample_id)""",
    ),
)
def _(spark, sf):
    raw = prep.is_relative(b.basket_cells(spark, sf)).withColumn("which", F.lit("raw"))
    return raw.unionByName(prep.is_relative(b.baskets(spark, sf)).withColumn("which", F.lit("closed")))


@query(
    "P4_to_relative",
    with_(b.PREPARED, select=f"SELECT sample_id, feature_id, {rd('value / total')} AS value FROM cells JOIN totals USING (sample_id)"),
)
def _(spark, sf):
    return prep.to_relative(b.basket_cells(spark, sf)).select("sample_id", "feature_id", _r("value"))


@query(
    "P5_prepare_features",
    with_(
        b.CELLS_ZERO,
        "t AS (SELECT sample_id, sum(value) AS total FROM zcells GROUP BY 1)",
        select=f"""SELECT sample_id, 'F' || feature_id AS feature_id, {rd('value / total')} AS value
  FROM zcells JOIN t USING (sample_id) WHERE value <> 0 AND total <> 0""",
    ),
)
def _(spark, sf):
    return prep.prepare_features(b.basket_cells_with_zeros(spark, sf), on_empty="drop").select(
        "sample_id", "feature_id", _r("value")
    )


_BUILDING = "building AS (SELECT * FROM customers WHERE segment = 'BUILDING')"


@query(
    "P6_align_samples",
    with_(
        b.CELLS,
        b.CUSTOMERS,
        _BUILDING,
        select="""SELECT 'samples' AS side, sample_id, NULL AS feature_id FROM building WHERE sample_id IN (SELECT sample_id FROM cells)
  UNION ALL SELECT 'abund', sample_id, feature_id FROM cells WHERE sample_id IN (SELECT sample_id FROM building)""",
    ),
)
def _(spark, sf):
    samples, abund = prep.align_samples(b.customers(spark, sf).where("segment = 'BUILDING'"), b.basket_cells(spark, sf))
    return samples.select(F.lit("samples").alias("side"), "sample_id", F.lit(None).cast("string").alias("feature_id")).unionByName(
        abund.select(F.lit("abund").alias("side"), "sample_id", "feature_id")
    )


@query(
    "U3_common_sample_ids",
    with_(b.CELLS, b.CUSTOMERS, _BUILDING, select="SELECT sample_id FROM building INTERSECT SELECT sample_id FROM cells"),
)
def _(spark, sf):
    return prep.common_sample_ids(b.customers(spark, sf).where("segment = 'BUILDING'"), b.basket_cells(spark, sf))


@query(
    "J1_build_dataset",
    with_(
        b.PREPARED,
        b.CUSTOMERS,
        select=f"SELECT sample_id, nation, segment, acctbal, feature_id, {rd('value')} AS value FROM customers JOIN abund USING (sample_id)",
    ),
)
def _(spark, sf):
    ds = prep.build_dataset(b.customers(spark, sf), b.basket_cells(spark, sf))
    return prep.merge_metadata(ds.samples.drop("t_off", "present"), ds.abund.drop("t_off")).withColumn("value", F.round("value", 9))


# --- statistics ---------------------------------------------------------------------------

_N = "(SELECT count(*) FROM customer)"


@query("A1_feature_abundance", with_(b.CELLS, select="SELECT feature_id, sum(value) AS abundance FROM cells GROUP BY 1"))
def _(spark, sf):
    return stats.feature_abundance(b.basket_cells(spark, sf))


# features as seen by every sample, zeros included
_GRID = """ids AS (SELECT DISTINCT sample_id FROM abund), feats AS (SELECT DISTINCT feature_id FROM abund),
grid AS (SELECT i.sample_id, f.feature_id, coalesce(a.value, 0) AS value FROM ids i CROSS JOIN feats f
         LEFT JOIN abund a ON a.sample_id = i.sample_id AND a.feature_id = f.feature_id)"""
_STATS = "fstats AS (SELECT feature_id, sum(value) AS abundance, var_samp(value) AS variance FROM grid GROUP BY 1)"


@query(
    "A2_feature_variance",
    with_(b.PREPARED, _GRID, _STATS, select=f"SELECT feature_id, {rd('variance * 1000')} AS variance_e3 FROM fstats"),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    return stats.feature_variance(ds.abund, ds.samples.count()).select(
        "feature_id", F.round(F.col("variance") * 1000, 9).alias("variance_e3")
    )


@query("A3_sample_totals", with_(b.CELLS, select="SELECT sample_id, sum(value) AS total FROM cells GROUP BY 1"))
def _(spark, sf):
    return prep.sample_totals(b.basket_cells(spark, sf))


@query(
    "A5_collapse_low",
    with_(
        b.CELLS,
        "s AS (SELECT feature_id, sum(value) AS a FROM cells GROUP BY 1)",
        "low AS (SELECT feature_id FROM s WHERE a < (SELECT avg(a) FROM s))",
        select="""SELECT sample_id, CASE WHEN l.feature_id IS NULL THEN c.feature_id ELSE 'F_low_abun' END AS feature_id, sum(value) AS value
  FROM cells c LEFT JOIN low l USING (feature_id) GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    cells = b.basket_cells(spark, sf)
    a = stats.feature_abundance(cells)
    mean = a.agg(F.avg("abundance")).first()[0]
    return sel.collapse_low(cells, a.where(F.col("abundance") < mean), "F_low_abun")


@query(
    "A6_alr_denominator",
    with_(
        b.PREPARED,
        "o AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS pos FROM (SELECT DISTINCT feature_id FROM abund))",
        "c AS (SELECT feature_id, count(*) AS cnt FROM abund WHERE value <> 0 GROUP BY 1)",
        select="SELECT feature_id, pos::INTEGER AS pos, cnt FROM o JOIN c USING (feature_id) ORDER BY cnt DESC, pos LIMIT 1",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    return stats.alr_denominator(ds.abund, sel.fit_selection(ds.abund, None, 1).select("feature_id", "pos"))


@query(
    "A7_threshold_bounds",
    with_(
        b.PREPARED,
        _GRID,
        _STATS,
        select=f"""SELECT 'abundance' AS measure, {rd('min(abundance)')} AS lo, {rd('max(abundance)')} AS hi FROM fstats
  UNION ALL SELECT 'variance', {rd('min(variance)', 9)}, {rd('max(variance)', 9)} FROM fstats""",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    n = ds.samples.count()
    parts = [
        stats.threshold_bounds(ds.abund, m, n, ds.features).select(
            F.lit(m).alias("measure"), F.round("lo", d).alias("lo"), F.round("hi", d).alias("hi")
        )
        for m, d in (("abundance", 9), ("variance", 9))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "A11_category_universe",
    """SELECT 'segment' AS "column", (row_number() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS pos, c_mktsegment AS category
  FROM (SELECT DISTINCT c_mktsegment FROM customer)
  UNION ALL SELECT 'nation', (row_number() OVER (ORDER BY n) - 1)::INTEGER, n FROM (SELECT DISTINCT c_nationkey::VARCHAR AS n FROM customer)""",
)
def _(spark, sf):
    return stats.category_universe(b.customers(spark, sf), ["segment", "nation"])


_LABELS = "idx AS (SELECT c_mktsegment AS label, row_number() OVER (ORDER BY c_mktsegment) - 1 AS y FROM (SELECT DISTINCT c_mktsegment FROM customer))"


@query(
    "A12_encode_decode_labels",
    with_(_LABELS, select="SELECT c_custkey::VARCHAR AS sample_id, c_mktsegment AS segment, y::DOUBLE AS y, label AS decoded FROM customer JOIN idx ON label = c_mktsegment"),
)
def _(spark, sf):
    samples = b.customers(spark, sf).select("sample_id", "segment")
    index = stats.label_index(samples, "segment")
    return stats.decode_labels(stats.encode_labels(samples, "segment", index), index, "y", "decoded")


# --- selection ----------------------------------------------------------------------------

_ORDERED = """o AS (SELECT *, row_number() OVER (ORDER BY {m}, feature_id) AS r, sum({m}) OVER (ORDER BY {m}, feature_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, count(*) OVER () AS n, sum({m}) OVER () AS tot FROM fstats)"""


def _low_sql(method: str, **p) -> list[str]:
    m, rule = method.split("_", 1)
    if rule == "threshold":
        return [f"low AS (SELECT feature_id FROM fstats WHERE {m} < {p['t']})"]
    if rule == "topi":
        return [
            f"low AS (SELECT feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY {m} DESC, feature_id) AS r FROM fstats) WHERE r > {p['i']})"
        ]
    if rule == "quantile":
        return [f"low AS (SELECT feature_id FROM fstats WHERE {m} < (SELECT quantile_cont({m}, {p['q']}) FROM fstats))"]
    return [
        _ORDERED.format(m=m),
        f"edge AS (SELECT {m} AS e FROM o WHERE r = n - {p['i']} + 1)",
        "low AS (SELECT feature_id FROM o, edge WHERE cum <= e AND tot > e)",
    ]


_FROZEN = """g AS (SELECT count(*) >= 2 AS grouped FROM low),
frozen AS (SELECT feature_id, false AS is_group FROM fstats, g WHERE NOT (grouped AND feature_id IN (SELECT feature_id FROM low))
  UNION ALL SELECT '{group}', true FROM g WHERE grouped)"""

_PARAMS = {
    "abundance_ith": {"i": 5},
    "variance_ith": {"i": 5},
    "abundance_topi": {"i": 6},
    "variance_topi": {"i": 6},
    "abundance_quantile": {"q": 0.7},
    "variance_quantile": {"q": 0.7},
    "abundance_threshold": {"t": 15.0},
    "variance_threshold": {"t": 0.0002},
}


def _register_selection(code: str, method: str, p: dict) -> None:
    group = "F_low_abun" if method.startswith("abundance") else "F_low_var"

    @query(
        f"{code}_select_{method}",
        with_(
            b.SKEWED,
            _GRID,
            _STATS,
            *_low_sql(method, **p),
            _FROZEN.format(group=group),
            select=f"""SELECT a.sample_id, coalesce(f.feature_id, '{group}') AS feature_id, {rd('sum(a.value)')} AS value
  FROM abund a LEFT JOIN frozen f USING (feature_id) GROUP BY 1, 2""",
        ),
    )
    def _(spark, sf):
        ds = b.skewed_dataset(spark, sf)
        frozen = sel.fit_selection(ds.abund, method, ds.samples.count(), **p)
        return sel.apply_selection(ds.abund, frozen).select("sample_id", "feature_id", _r("value"))


for _i, (_m, _p) in enumerate(_PARAMS.items(), 1):
    _register_selection(f"T{_i}", _m, _p)


@query(
    "T9_fit_selection_frozen",
    with_(
        b.PREPARED,
        _GRID,
        _STATS,
        *_low_sql("abundance_topi", i=6),
        _FROZEN.format(group="F_low_abun"),
        select="SELECT (row_number() OVER (ORDER BY is_group, feature_id) - 1)::INTEGER AS pos, feature_id, is_group, count(*) OVER () AS n_selected FROM frozen",
    ),
)
def _(spark, sf):
    ds = b.basket_dataset(spark, sf)
    return sel.fit_selection(ds.abund, "abundance_topi", ds.samples.count(), i=6)


@query(
    "W2_ordered_cumulative_abundance",
    with_(b.CELLS, "fstats AS (SELECT feature_id, sum(value) AS abundance FROM cells GROUP BY 1)", _ORDERED.format(m="abundance"),
          select="SELECT feature_id, abundance, r AS rank, cum, n FROM o"),
)
def _(spark, sf):
    from closura.operators.ordered import ordered_prefix

    a = stats.feature_abundance(b.basket_cells(spark, sf))
    return ordered_prefix(a, [], [F.col("abundance"), F.col("feature_id")], value="abundance")


@query(
    "W5_ordered_prefix",
    with_(
        b.CELLS,
        select="""SELECT feature_id, sample_id, value, row_number() OVER w AS rank, count(*) OVER (PARTITION BY feature_id) AS n,
   sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM cells WINDOW w AS (PARTITION BY feature_id ORDER BY value, sample_id)""",
    ),
)
def _(spark, sf):
    from closura.operators.ordered import ordered_prefix

    return ordered_prefix(b.basket_cells(spark, sf), ["feature_id"], [F.col("value"), F.col("sample_id")], value="value")


# --- reindexing and transforms ------------------------------------------------------------

_TOP6 = [b.PREPARED, _GRID, _STATS, *_low_sql("abundance_topi", i=6), _FROZEN.format(group="F_low_abun"),
          """sel AS (SELECT g.sample_id, coalesce(f.feature_id, 'F_low_abun') AS feature_id, sum(g.value) AS value
   FROM grid g LEFT JOIN frozen f USING (feature_id) GROUP BY 1, 2)""",
          """pos AS (SELECT feature_id, row_number() OVER (ORDER BY is_group, feature_id) - 1 AS pos FROM frozen)""",
          "dense AS (SELECT sample_id, pos, feature_id, value FROM sel JOIN pos USING (feature_id))",
          "eps AS (SELECT *, CASE WHEN value = 0 THEN 1e-9 ELSE value END AS v FROM dense)"]


def top6(spark, sf):
    """Baskets after abundance_topi (i=6) as dense rows, with their frozen features."""
    ds = b.basket_dataset(spark, sf)
    frozen = sel.fit_selection(ds.abund, "abundance_topi", ds.samples.count(), i=6)
    return dense_rows(ds.samples.select("sample_id"), ds.abund, frozen), frozen


def cells_of(frame, frozen, out="value", names="feature_id"):
    """Dense rows as (sample_id, name, value). Rows are never empty; the outer form keeps the
    optimizer from computing x a second time in a size(x) > 0 filter."""
    long = frame.select("sample_id", F.posexplode_outer("x").alias("pos", out))
    if names is None:
        return long.withColumn(out, F.round(out, 9))
    return long.join(frozen.select("pos", F.col("feature_id").alias(names)), "pos").select("sample_id", names, F.round(out, 9).alias(out))


@query("J7_apply_selection_dense", with_(*_TOP6, select=f"SELECT sample_id, feature_id, {rd('value')} AS value FROM dense"))
def _(spark, sf):
    return cells_of(*top6(spark, sf))


@query("F1_pseudocount", with_(*_TOP6, select=f"SELECT sample_id, feature_id, {rd('ln(v)')} AS value FROM eps"))
def _(spark, sf):
    x, frozen = top6(spark, sf)
    return cells_of(x.withColumn("x", F.transform(rows.pseudocount(F.col("x")), F.ln)), frozen)


CLR_SQL = with_(
    *_TOP6, select=f"SELECT sample_id, feature_id, {rd('ln(v) - avg(ln(v)) OVER (PARTITION BY sample_id)')} AS clr FROM eps"
)


def clr_query(spark, sf):
    x, frozen = top6(spark, sf)
    return cells_of(x.withColumn("x", rows.clr(rows.pseudocount(F.col("x")))), frozen, "clr")


query("F2_clr", CLR_SQL)(clr_query)


@query(
    "F3_ilr",
    with_(
        *_TOP6,
        "l AS (SELECT sample_id, pos, ln(v) AS lv, avg(ln(v)) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM eps)",
        select=f"SELECT sample_id, (pos - 1)::INTEGER AS pos, {rd('sqrt(pos / (pos + 1.0)) * (m - lv)')} AS ilr FROM l WHERE pos >= 1",
    ),
)
def _(spark, sf):
    x, frozen = top6(spark, sf)
    return cells_of(x.withColumn("x", rows.ilr(rows.pseudocount(F.col("x")))), frozen, "ilr", None)


@query(
    "F4_alr",
    with_(
        *_TOP6,
        "nz AS (SELECT pos FROM dense GROUP BY pos ORDER BY count_if(value <> 0) DESC, pos LIMIT 1)",
        "d AS (SELECT sample_id, v AS dv FROM eps WHERE pos = (SELECT pos FROM nz))",
        select=f"""SELECT sample_id, (CASE WHEN pos > (SELECT pos FROM nz) THEN pos - 1 ELSE pos END)::INTEGER AS pos, v / dv AS alr,
   {rd('ln(v / dv)')} AS alr_log FROM eps JOIN d USING (sample_id) WHERE pos <> (SELECT pos FROM nz)""",
    ),
)
def _(spark, sf):
    x, frozen = top6(spark, sf)
    ds = b.basket_dataset(spark, sf)
    d = stats.alr_denominator(sel.apply_selection(ds.abund, frozen).drop("pos"), frozen.select("feature_id", "pos")).first()["pos"]
    x = rows.pseudocount(F.col("x")), x
    pair = F.arrays_zip(rows.alr(x[0], d).alias("a"), rows.alr_log(x[0], d).alias("l"))
    return x[1].select("sample_id", F.posexplode_outer(pair).alias("pos", "p")).select(
        "sample_id", "pos", F.col("p.a").alias("alr"), F.round("p.l", 9).alias("alr_log")
    )


@query("F5_presence_absence", with_(*_TOP6, select="SELECT sample_id, feature_id, CASE WHEN value <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pa FROM dense"))
def _(spark, sf):
    x, frozen = top6(spark, sf)
    return cells_of(x.withColumn("x", rows.presence_absence(F.col("x"))), frozen, "pa")


@query(
    "F6_rank_row",
    with_(
        *_TOP6,
        "k AS (SELECT sample_id, feature_id, value, rank() OVER (PARTITION BY sample_id ORDER BY value DESC) AS r FROM dense)",
        select="SELECT sample_id, feature_id, r + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0::DOUBLE AS rank FROM k",
    ),
)
def _(spark, sf):
    x, frozen = top6(spark, sf)
    return cells_of(x.withColumn("x", rows.rank_row(F.col("x"))), frozen, "rank")
