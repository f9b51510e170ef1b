"""Near-duplicate documents by min-max hashing.

A document's set holds the distinct runs of five words (all words, if fewer), lower-cased A-Z. Under
each of ``PERMUTATIONS`` hash functions a set keeps its least *and* its greatest value: both collide
with the probability of the sets' similarity, so one evaluation gives two of the signature's values.
Values are banded ``ROWS`` at a time (bands of minima and bands of maxima); sets of similarity 0.75
miss all 40 bands with a probability of 2e-5, and less if they are more alike.

Equal sets are one class and are never compared. In a bucket (classes that share a band) members are
not paired with each other. A bucket's hub is the member that meets most others, over all its
buckets: in a group of edited copies that is the original, or one close to it.

1. every class is compared with the one hub it shares most bands with;
2. buckets whose classes are not all joined by then compare each member with the bucket's hub;
3. the members of buckets still apart meet by an exact prefix join on their rarest shingles: only
   pairs of different components that can reach 0.75 by their sizes and the places of their first
   common shingle are compared. A heavily edited copy has many shingles of its own, so such copies of
   one original do not meet each other.

Comparisons are on whole sets (40 bits of every shingle's hash). Components come from repeated
hooking to the least neighbour and pointer jumping, all in Spark.

Defined results: no words: no set, linked with nothing; rows with null doc_id are linked with nothing,
kept, and have no component; rows with equal doc_id and text get equal results; an empty table gives
an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from closura.llm import wordhash
from closura.llm.decontaminate import checked
from closura.session import materialize, release

SHINGLE = 5
PERCENT = 75
PERMUTATIONS = 100
ROWS = 5
SET_BYTES = 5  # of each shingle's hash

_rng = np.random.Generator(np.random.PCG64(75))
_TIMES, _PLUS = (_rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_PLACES = _rng.integers(1, 2**63, SHINGLE + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = np.arange(2 * PERMUTATIONS // ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text the ascending distinct hashes of its shingles."""
    words, bounds = wordhash.hashes(texts)
    words = words.view(np.uint64)
    size = max(0, len(words) - SHINGLE + 1)
    runs = np.zeros(size, np.uint64)
    for k in range(SHINGLE):
        runs += wordhash.mix(words[k : k + size]) * _PLACES[k]
    runs = wordhash.mix(runs)
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        else:
            whole = np.sum(wordhash.mix(words[a:b]) * _PLACES[: b - a], dtype=np.uint64) + np.uint64(b - a)
            yield wordhash.mix(whole[None])[: int(b > a)]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(shingles), 1024):
        values = shingles[k : k + 1024, None] * _TIMES + _PLUS
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    bands = np.concatenate([low, high]).reshape(-1, ROWS) * _PLACES[SHINGLE:]
    return wordhash.mix(bands.sum(1, dtype=np.uint64) + _BANDS).view(np.int64)


def fingerprint(shingles: np.ndarray) -> int:
    return int(wordhash.mix(np.sum(wordhash.mix(shingles), dtype=np.uint64)[None] + np.uint64(len(shingles))).view(np.int64)[0])


def _key(docs: DataFrame, ident: str, text: str) -> Column:
    return F.xxhash64(docs[ident], docs[text])


def signatures(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Written rows: ident, key, n_shingles, fp (of the set, null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in wordhash.slices(batch.column(2)):
                sets = list(shingle_sets(texts))
                columns = [
                    batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["ident", "key", "n_shingles", "fp", "bands"])
                at += len(texts)

    kind = docs.schema[ident].dataType.simpleString()
    rows = docs.select(docs[ident].alias("ident"), _key(docs, ident, text).alias("key"), docs[text].alias("text"))
    return materialize(rows.mapInArrow(run, f"ident {kind}, key bigint, n_shingles bigint, fp bigint, bands array<bigint>"))


def whole_sets(docs: DataFrame, wanted: DataFrame, ident: str, text: str) -> DataFrame:
    """Written rows fp, shingles of the documents whose key is in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in wordhash.slices(batch.column(0)):
                sets = list(shingle_sets(texts))
                cut = [np.unique(s & np.uint64(2 ** (8 * SET_BYTES) - 1)) for s in sets]
                packed = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes() for s in cut]
                yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets]), pa.array(packed, pa.binary())], ["fp", "shingles"])

    rows = docs.select(_key(docs, ident, text).alias("key"), docs[text].alias("text")).join(checked(wanted), "key", "left_semi")
    return materialize(rows.select("text").mapInArrow(run, "fp bigint, shingles binary").dropDuplicates(["fp"]))


def unpack(packed: bytes) -> np.ndarray:
    raw = np.zeros((len(packed) // SET_BYTES, 8), np.uint8)
    raw[:, :SET_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, SET_BYTES)
    return raw.view("<u8").ravel()


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Written rows a, b, linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = unpack(left.as_py()), unpack(right.as_py())
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                either = len(x) + len(y) - common
                linked.append(100 * common >= PERCENT * either)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    of = lambda side: sets.select(F.col("fp").alias(side), F.col("shingles").alias(f"{side}_set"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set")
    return materialize(both.mapInArrow(run, "a bigint, b bigint, linked boolean"))


def prefix_pairs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b of ``nodes`` (fp, label) with different labels: all that can be linked, and few more.

    Shingles are ordered from the rarest on. Linked sets share one of the first quarter of the larger
    set's and of the first seventh of the smaller set's, and at their first common shingle enough of
    both must be left. Shingles of one holder take the front places and are not joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shingles = unpack(packed).astype(np.int64)
                n = len(shingles)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, fp)), pa.array(np.full(n, n)), pa.array(shingles)], ["fp", "n", "shingle"])

    each = sets.join(checked(nodes), "fp").select("fp", "shingles").mapInArrow(run, "fp bigint, n bigint, shingle bigint")
    holders = materialize(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"))
    of_one = Window.partitionBy("fp")
    front = F.col("n") - F.count(F.lit(1)).over(of_one)
    placed = each.join(checked(holders), "shingle").withColumn("place", front + F.row_number().over(of_one.orderBy("holders", "shingle")))
    least = lambda share, whole: F.expr(f"(n * {share} + {whole - 1}) DIV {whole}")
    placed = placed.where(F.col("place") <= F.col("n") - least(PERCENT, 100) + 1).join(checked(nodes), "fp")
    placed = materialize(placed.select("fp", "label", "n", "shingle", "place"))
    small = placed.where(F.col("place") <= F.col("n") - least(2 * PERCENT, 100 + PERCENT) + 1)
    large = placed.withColumnsRenamed({c: f"_{c}" for c in placed.columns})
    left_over = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place")) + 1
    can_be = (
        (F.col("label") != F.col("_label")) & (F.col("n") <= F.col("_n")) & (100 * F.col("n") >= PERCENT * F.col("_n"))
        & ((100 + PERCENT) * left_over >= PERCENT * (F.col("n") + F.col("_n")))
    )
    pairs = small.join(large, (F.col("shingle") == F.col("_shingle")) & can_be)
    return pairs.select(F.greatest("fp", "_fp").alias("a"), F.least("fp", "_fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Written rows node, root (the least node reachable) of all nodes of ``edges`` (a, b)."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        tree = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
        while True:
            up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = materialize(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            release(tree)
            tree = jumped
            if tree.where("moved").isEmpty():
                break
        tree_of = lambda side: tree.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        rest = edges.join(tree_of("a"), "a").join(tree_of("b"), "b").where("a_root <> b_root")
        rest = materialize(rest.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
        release(edges)
        edges = rest
        if labels is None:
            labels = tree.select("node", "root")
        else:
            higher = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
            labels = labels.join(higher, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
        if edges.isEmpty():
            return materialize(labels)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (bucket, fp, hub, label) of buckets with more than one label."""
    labelled = members.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("label", F.coalesce("root", "fp")).drop("root")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return labelled.join(checked(materialize(mixed)), "bucket", "left_semi")


def links(docs: DataFrame, rows: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes (fp, first, copies) and written components (node, root) of linked classes; rows: from ``signatures``."""
    known = rows.where("fp IS NOT NULL AND ident IS NOT NULL")
    classes = materialize(known.groupBy("fp").agg(F.min(F.struct("ident", "key")).alias("first"), F.count(F.lit(1)).alias("copies")))
    classes = classes.select("fp", F.col("first.ident").alias("first"), F.col("first.key").alias("key"), "copies")

    banded = known.dropDuplicates(["fp"]).select("fp", F.explode("bands").alias("bucket"))
    sizes = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = materialize(banded.join(checked(sizes), "bucket"))
    known_to = shared.groupBy("fp").agg(F.sum("size").alias("known"))
    ranked = materialize(shared.join(checked(materialize(known_to)), "fp").select("bucket", "fp", F.struct("known", "fp").alias("place")))
    hubs = ranked.groupBy("bucket").agg(F.max("place").alias("hub"))
    members = materialize(ranked.join(checked(materialize(hubs)), "bucket").select("bucket", "fp", "place", "hub"))
    release(sizes, shared, ranked)
    pairs = members.where("place <> hub").groupBy(F.col("fp").alias("a"), "hub").agg(F.count(F.lit(1)).alias("bands"))
    pairs = materialize(pairs)
    written, members = members, members.select("bucket", "fp", F.col("hub.fp").alias("hub"))
    suspects = members.select("fp").distinct().join(classes, "fp").select("key").distinct()
    sets = whole_sets(docs, suspects, ident, text)

    best = pairs.groupBy("a").agg(F.max(F.struct("bands", "hub")).alias("best")).select("a", F.col("best.hub.fp").alias("b"))
    first = compare(best, sets)
    labels = components(first.where("linked"))

    apart = materialize(_apart(members, labels))
    more = apart.where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    second = compare(more, sets)
    tested = first.union(second)
    if not second.where("linked").isEmpty():
        labels = components(tested.where("linked"))

    nodes = materialize(_apart(apart.drop("label"), labels).select("fp", "label").distinct())
    third = compare(prefix_pairs(sets, nodes), sets)
    if not third.where("linked").isEmpty():
        labels = components(tested.union(third).where("linked"))
    release(written, pairs, sets)
    return classes, labels


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, n_shingles, component_id, kept (and ``key``) of every row."""
    rows = signatures(docs, ident, text)
    classes, labels = links(docs, rows, ident, text)
    grouped = classes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").where("copies > 1 OR root IS NOT NULL")
    grouped = materialize(grouped.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    fate = materialize(grouped.join(least, "root").select("fp", "component"))
    out = rows.select("ident", "key", "n_shingles", "fp").join(checked(fate), "fp", "left")
    component = F.when(F.col("ident").isNotNull(), F.coalesce("component", "ident"))
    return out.select(
        F.col("ident").alias(ident), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("ident"), F.lit(True)).alias("kept"), "key"
    )


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept rows, with all their columns."""
    gone = materialize(judge(docs, ident, text).where("NOT kept").select(F.col("key").alias("__gone")).distinct())
    return docs.join(checked(gone), _key(docs, ident, text) == F.col("__gone"), "left_anti")
