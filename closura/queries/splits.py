"""Splits, folds and their checks on the customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura import bindings as b
from closura.operators import splits as sp
from closura.oracle import with_
from closura.plans.split_tables import split_train_test
from closura.queries import query
from closura.queries.features import hash_sql

_BASE = "cu AS (SELECT c_custkey::VARCHAR AS sample_id, c_nationkey AS nation, c_nationkey % 3 AS zone, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer)"


def people(spark, sf):
    return b.customers(spark, sf).withColumn("zone", F.col("nation") % 3)


def _cut(f: float, part: str, src: str, ident: str, seed: int) -> str:
    over = f"PARTITION BY {part} " if part else ""
    n = f"count(*) OVER ({'PARTITION BY ' + part if part else ''})"
    return f"CASE WHEN row_number() OVER ({over}ORDER BY {hash_sql(seed, ident)}, {ident}) <= floor({f} * {n} + 1e-9) THEN 'train' ELSE 'test' END AS split FROM {src}"


@query("K1_split_random", with_(_BASE, select=f"SELECT sample_id, {_cut(0.8, '', 'cu', 'sample_id', 42)}"))
def _(spark, sf):
    return sp.split(people(spark, sf), 0.8, 42).select("sample_id", "split")


@query("K1_split_approximate", with_(_BASE, select=f"SELECT sample_id, CASE WHEN {hash_sql(42, 'sample_id')} < {int(0.8 * 2**32)} THEN 'train' ELSE 'test' END AS split FROM cu"))
def _(spark, sf):
    return sp.split(people(spark, sf), 0.8, 42, approx=True).select("sample_id", "split")


@query("K2_split_stratified", with_(_BASE, select=f"SELECT sample_id, {_cut(0.7, 'segment, zone', 'cu', 'sample_id', 42)}"))
def _(spark, sf):
    return sp.split(people(spark, sf), 0.7, 42, stratify=["segment", "zone"]).select("sample_id", "split")


_GROUPS = "gr AS (SELECT DISTINCT nation, zone FROM cu)"


@query("K3_split_grouped", with_(_BASE, _GROUPS, f"a AS (SELECT nation, {_cut(0.6, '', 'gr', 'nation', 5)})", select="SELECT sample_id, nation, split FROM cu JOIN a USING (nation)"))
def _(spark, sf):
    return sp.split(people(spark, sf), 0.6, 5, group="nation").select("sample_id", "nation", "split")


@query("K4_split_grouped_stratified", with_(_BASE, _GROUPS, f"a AS (SELECT nation, {_cut(0.6, 'zone', 'gr', 'nation', 5)})", select="SELECT sample_id, nation, split FROM cu JOIN a USING (nation)"))
def _(spark, sf):
    return sp.split(people(spark, sf), 0.6, 5, group="nation", stratify=["zone"]).select("sample_id", "nation", "split")


@query("K5_split_all_test", with_(_BASE, select="SELECT sample_id, 'test' AS split FROM cu"))
def _(spark, sf):
    return sp.split(people(spark, sf), 0.0, 42).select("sample_id", "split")


@query("K6_folds_plain", with_(_BASE, select=f"SELECT sample_id, ((row_number() OVER (ORDER BY {hash_sql(9, 'sample_id')}, sample_id) - 1) % 5)::INTEGER AS fold FROM cu"))
def _(spark, sf):
    return sp.assign_folds(people(spark, sf), 5, 9)


@query(
    "K7_folds_stratified",
    with_(
        _BASE,
        "st AS (SELECT segment, coalesce(sum(count(*)) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cu GROUP BY 1)",
        select=f"SELECT sample_id, ((row_number() OVER (PARTITION BY segment ORDER BY {hash_sql(9, 'sample_id')}, sample_id) - 1 + start) % 5)::INTEGER AS fold FROM cu JOIN st USING (segment)",
    ),
)
def _(spark, sf):
    return sp.assign_folds(people(spark, sf), 5, 9, stratify=["segment"])


def _dealt(part: str, start: str) -> str:
    over = f"PARTITION BY {part} " if part else ""
    return f"""SELECT nation, ((CASE WHEN t < 4 THEN t ELSE 7 - t END + {start}) % 4)::INTEGER AS fold FROM (
  SELECT *, (row_number() OVER ({over}ORDER BY size DESC, {hash_sql(9, 'nation')}, nation) - 1) % 8 AS t FROM sized)"""


_SIZED = "sized AS (SELECT nation, zone, count(*) AS size FROM cu GROUP BY 1, 2)"


@query("K8_folds_grouped", with_(_BASE, _SIZED, f"a AS ({_dealt('', '0')})", select="SELECT sample_id, fold FROM cu JOIN a USING (nation)"))
def _(spark, sf):
    return sp.assign_folds(people(spark, sf), 4, 9, group="nation")


@query(
    "K9_folds_grouped_stratified",
    with_(
        _BASE, _SIZED.replace("sized AS", "sized0 AS"),
        "st AS (SELECT zone, coalesce(sum(count(*)) OVER (ORDER BY zone::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized0 GROUP BY 1)",
        "sized AS (SELECT * FROM sized0 JOIN st USING (zone))",
        f"a AS ({_dealt('zone', 'start')})",
        select="SELECT sample_id, fold FROM cu JOIN a USING (nation)",
    ),
)
def _(spark, sf):
    return sp.assign_folds(people(spark, sf), 4, 9, group="nation", stratify=["zone"])


@query("J5_rows_of_groups", with_(_BASE, "a AS (SELECT DISTINCT nation, nation % 2 AS side FROM cu)", select="SELECT nation, sample_id, side FROM cu JOIN a USING (nation)"))
def _(spark, sf):
    p = people(spark, sf).select("nation", "sample_id")
    return sp.rows_of_groups(p, p.select("nation", (F.col("nation") % 2).alias("side")).distinct(), "nation")


@query(
    "K10_split_train_test_static",
    with_(
        b.PREPARED, b.ALIGNED,
        select=f"SELECT sample_id, segment, {_cut(0.8, 'segment', 'samples', 'sample_id', 3)}",
    ),
)
def _(spark, sf):
    ds, marks = split_train_test(b.customers(spark, sf), b.basket_cells(spark, sf), 0.8, 3, stratify=["segment"])
    return ds.samples.select("sample_id", "segment").join(marks, "sample_id")


@query(
    "K10_split_train_test_temporal",
    with_(
        b.ACTIVITY,
        "w AS (SELECT s.sample_id, s.host FROM asamples s JOIN asamples p ON p.host = s.host AND p.time = s.time - 1)",
        "hosts AS (SELECT DISTINCT host FROM w)",
        f"a AS (SELECT host, {_cut(0.75, '', 'hosts', 'host', 3)})",
        select="SELECT sample_id, host, split FROM w JOIN a USING (host)",
    ),
)
def _(spark, sf):
    ds, marks = split_train_test(
        b.activity_samples(spark, sf), b.activity_cells(spark, sf), 0.75, 3, group="host", host="host", time="time", n_prev=1
    )
    return ds.samples.where("t_off = 0").select("sample_id", "host").join(marks, "sample_id")


@query(
    "A8_feasible_k",
    with_(
        _BASE,
        select="""SELECT 'rows' AS unit, count(*)::BIGINT AS n_units, (SELECT min(c) FROM (SELECT count(*) AS c FROM cu GROUP BY segment)) AS smallest FROM cu
  UNION ALL SELECT 'groups', count(DISTINCT nation), (SELECT min(c) FROM (SELECT count(DISTINCT nation) AS c FROM cu GROUP BY zone)) FROM cu""",
    ),
)
def _(spark, sf):
    rows = sp.feasible_k(people(spark, sf), target="segment", task="classification").withColumn("unit", F.lit("rows"))
    groups = sp.feasible_k(people(spark, sf), group="nation", stratify=["zone"]).withColumn("unit", F.lit("groups"))
    return rows.unionByName(groups)


@query("A9_inconstant_groups", with_(_BASE, select="SELECT nation FROM cu GROUP BY 1 HAVING count(DISTINCT segment) > 1"))
def _(spark, sf):
    return sp.inconstant_groups(people(spark, sf), "nation", ["segment"])


@query("A10_group_counts", with_(_BASE, select="SELECT nation, count(*) AS n FROM cu GROUP BY 1"))
def _(spark, sf):
    p = people(spark, sf)
    sp.require_groups(p, "nation", 2)
    return p.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
