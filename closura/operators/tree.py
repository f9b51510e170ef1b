"""Trees over features as edge tables: closure, pruning, node names, node means.

``edges`` has one row per non-root node: node, parent, is_tip, ord. A parent that is
not itself a node is the root. ``ord`` fixes the order of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.dataset import PSEUDOCOUNT
from closura.functions.rows import lay_out, sorted_entries
from closura.functions.taxon import before_last_semicolon, common_prefix, leaf_name
from closura.operators.ordered import ordered_prefix
from closura.session import materialize

MAX_DOUBLINGS = 40


def ancestor_paths(edges: DataFrame) -> DataFrame:
    """node -> array of its proper ancestors, nearest first, root excluded.

    Path doubling: each round appends the path of the node a path ends at, so a tree of
    depth d needs log2(d) joins. Finished nodes leave the join, so nodes that have
    reached the top do not pile up on one key. Each round is a written table.
    """
    nodes = edges.select("node")
    parents = edges.select("node", "parent").join(
        nodes.select(F.col("node").alias("parent"), F.lit(True).alias("_known")), "parent", "left"
    )
    state = materialize(
        parents.select(
            "node",
            F.when(F.col("_known"), F.array("parent")).otherwise(F.array().cast("array<string>")).alias("path"),
            F.when(F.col("_known"), F.col("parent")).alias("end"),
        )
    )
    for _ in range(MAX_DOUBLINGS):
        looped = F.max(F.when(F.array_contains("path", F.col("node")), F.col("node")))
        waiting, on_cycle = state.agg(F.count("end"), looped).first()
        if on_cycle is not None:  # a node above itself; paths would double for ever
            raise ValueError(f"the edge table contains a cycle through {on_cycle}")
        if not waiting:
            return state.select("node", "path")
        open_rows = state.where("end is not null")
        further = state.select(F.col("node").alias("end"), F.col("path").alias("_more"), F.col("end").alias("_end"))
        state = materialize(
            open_rows.join(further, "end")
            .select("node", F.concat("path", "_more").alias("path"), F.col("_end").alias("end"))
            .unionByName(state.where("end is null"))
        )
    raise ValueError("the tree is too deep")


def tip_ancestor_pairs(edges: DataFrame) -> DataFrame:
    """(tip, node, node_ord) for every tip below every internal node."""
    tips = edges.where("is_tip").select("node")
    pairs = ancestor_paths(edges).join(tips, "node", "left_semi").select(
        F.col("node").alias("tip"), F.explode("path").alias("node")
    )
    return pairs.join(edges.select("node", F.col("ord").alias("node_ord")), "node").select("tip", "node", "node_ord")


def tip_ancestors(edges: DataFrame) -> DataFrame:
    """The aggregation matrix as rows (tip, node, is_tip, node_ord, n_leaves).

    Leaves of tree nodes are nested or disjoint, so two nodes cover the same leaves exactly
    when they share the leaf count and the smallest leaf; of those the first in order stays.
    """
    pairs = tip_ancestor_pairs(edges)
    nodes = pairs.groupBy("node", "node_ord").agg(F.count(F.lit(1)).alias("n_leaves"), F.min("tip").alias("_low"))
    n_tips = edges.where("is_tip").count()
    kept = (
        nodes.groupBy("n_leaves", "_low")
        .agg(F.min(F.struct("node_ord", "node")).alias("s"))
        .select(
            F.col("s.node").alias("node"),
            F.when(
                F.col("n_leaves") == n_tips,
                F.raise_error(F.concat(F.lit("a node below the root covers every leaf: "), F.col("s.node"))).cast("bigint"),
            )
            .otherwise(F.col("n_leaves"))
            .alias("n_leaves"),
        )
    )
    inner = pairs.join(kept, "node").select("tip", "node", F.lit(False).alias("is_tip"), "node_ord", "n_leaves")
    leaves = edges.where("is_tip").select(
        F.col("node").alias("tip"), "node", F.lit(True).alias("is_tip"), F.col("ord").alias("node_ord"), F.lit(1).cast("bigint").alias("n_leaves")
    )
    return leaves.unionByName(inner)


def prune_tree(edges: DataFrame, features: DataFrame) -> DataFrame:
    """Keep the tips that are features and the nodes above them; nodes left with a single
    child are spliced out."""
    tips = edges.where("is_tip").join(features.select(F.col("feature_id").alias("node")), "node", "left_semi")
    paths = ancestor_paths(edges)
    steps = paths.join(tips.select("node"), "node", "left_semi").select(F.col("node").alias("tip"), F.posexplode("path").alias("depth", "node"))
    reached = steps.select("node").distinct()
    below = edges.select("node", "parent").join(
        reached.unionByName(tips.select("node")), "node", "left_semi"
    )
    forks = below.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("node")
    inner = edges.where("not is_tip").join(reached, "node", "left_semi").join(forks, "node", "left_semi")
    survivors = inner.unionByName(tips)
    # nearest surviving ancestor becomes the parent
    up = (
        paths.join(survivors.select("node"), "node", "left_semi")
        .select("node", F.posexplode("path").alias("depth", "anc"))
        .join(inner.select(F.col("node").alias("anc")), "anc", "left_semi")
        .groupBy("node")
        .agg(F.min_by("anc", "depth").alias("_up"))
    )
    return survivors.join(up, "node", "left").select(
        "node", F.coalesce("_up", F.lit("root")).alias("parent"), "is_tip", "ord"
    )


def node_names(matrix: DataFrame, tax: DataFrame) -> DataFrame:
    """node -> display name: ``taxon; otu__id`` for tips; for inner nodes the common lineage of
    their leaves cut at the last ``;``, with ``; n__<ord>`` appended to repeats.

    The common prefix of a set of strings is that of its smallest and largest member.
    """
    named = matrix.join(
        tax.select(F.col("feature_id").alias("tip"), leaf_name(F.col("taxon"), F.col("feature_id")).alias("leaf")), "tip"
    )
    tips = named.where("is_tip").select("node", F.col("leaf").alias("name"))
    inner = (
        named.where("not is_tip")
        .groupBy("node", "node_ord")
        .agg(F.min("leaf").alias("lo"), F.max("leaf").alias("hi"))
        .select("node", "node_ord", before_last_semicolon(common_prefix(F.col("lo"), F.col("hi"))).alias("base"))
    )
    first = inner.groupBy("base").agg(F.min("node_ord").alias("_first"))
    inner = inner.join(first, "base").select(
        "node",
        F.when(F.col("node_ord") == F.col("_first"), F.col("base"))
        .otherwise(F.concat(F.col("base"), F.lit("; n__"), F.col("node_ord").cast("string")))
        .alias("name"),
    )
    return tips.unionByName(inner)


def matrix_columns(matrix: DataFrame) -> DataFrame:
    """(node, col, n_leaves): tips first, then inner nodes, each in their own order."""
    nodes = matrix.groupBy("node", "is_tip", "node_ord").agg(F.max("n_leaves").alias("n_leaves"))
    ranked = ordered_prefix(nodes, [], [F.col("is_tip").desc(), F.col("node_ord"), F.col("node")])
    return ranked.select("node", (F.col("rank") - 1).cast("int").alias("col"), "n_leaves")


def inner_columns(columns: DataFrame) -> DataFrame:
    """The columns of nodes with several leaves alone, numbered anew in their order."""
    ranked = ordered_prefix(columns.where("n_leaves > 1"), [], [F.col("col")])
    return ranked.select("node", (F.col("rank") - 1).cast("int").alias("col"), "n_leaves")


def log_geom(samples: DataFrame, abund: DataFrame, matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """sample_id, x: per node the mean of ln(value + pseudocount) over its leaves.

    Of tables with windows the present snapshot (``t_off`` 0) is taken. Only non-zero cells are joined; a node's zero leaves add a constant, and a node without
    any non-zero leaf is filled with it, so no samples x nodes grid is built.
    """
    floor = F.lit(PSEUDOCOUNT)
    width = columns.count()
    samples, abund = (df.where("t_off = 0") if "t_off" in df.columns else df for df in (samples, abund))
    per_node = (
        abund.select("sample_id", F.col("feature_id").alias("tip"), F.log(F.col("value") + floor).alias("_l"))
        .join(matrix.select("tip", "node").join(columns, "node"), "tip")
        .groupBy("sample_id", "col", "n_leaves")
        .agg(F.sum("_l").alias("_s"), F.count(F.lit(1)).alias("_nnz"))
        .select(
            "sample_id",
            F.struct(
                F.col("col").alias("pos"),
                ((F.col("_s") + (F.col("n_leaves") - F.col("_nnz")) * F.log(floor)) / F.col("n_leaves")).alias("value"),
            ).alias("e"),
        )
        .groupBy("sample_id")
        .agg(F.collect_list("e").alias("e"))
    )
    sparse = samples.select("sample_id").join(per_node, "sample_id", "left").select("sample_id", sorted_entries(F.col("e")).alias("e"))
    return sparse.select("sample_id", lay_out(F.col("e"), F.lit(width), F.log(floor)).alias("x"))


def log_geom_cells(samples: DataFrame, abund: DataFrame, matrix: DataFrame, columns: DataFrame) -> DataFrame:
    """sample_id, pos, value: the cells of ``log_geom`` that are not its constant, less that constant, by column. As long as
    a sample's non-zero features and the nodes above them, whatever the number of columns; cells are dealt by sample once."""
    floor = F.lit(PSEUDOCOUNT)
    samples, abund = (df.where("t_off = 0") if "t_off" in df.columns else df for df in (samples, abund))
    above = matrix.select("tip", "node").join(columns, "node").groupBy("tip").agg(F.collect_list(F.struct(F.col("col").alias("pos"), "n_leaves")).alias("to"))
    logs = abund.select("sample_id", F.col("feature_id").alias("tip"), (F.log(F.col("value") + floor) - F.log(floor)).alias("_l")).join(above, "tip")
    per_node = (
        logs.select("sample_id", "_l", "to")
        .repartition("sample_id")
        .select("sample_id", "_l", F.explode("to").alias("to"))
        .groupBy("sample_id", "to.pos", "to.n_leaves")
        .agg(F.sum("_l").alias("_s"))
        .groupBy("sample_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("_s") / F.col("n_leaves")).alias("value")))).alias("e"))
    )
    cells = samples.select("sample_id").join(per_node, "sample_id", "left")
    part = lambda name, kind: F.coalesce(F.col(f"e.{name}"), F.array()).cast(f"array<{kind}>").alias(name)
    return cells.select("sample_id", part("pos", "int"), part("value", "double"))
