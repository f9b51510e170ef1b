"""Hard negatives by Four-Russians scoring: table lookups in place of multiplications, exact integer scores.

Components are integers. Candidates are packed once, a few thousand to a block: in two's complement
each bit plane of eight dimensions is one byte. For a block of anchors the sums of all 256 subsets of
every eight dimensions are laid out as tables, built by doubling. A plane's share of the inner product
is then one lookup for each byte, and planes are added from the sign bit down by shifting.

Blocks of anchors meet blocks of candidates in a grid: candidates are read in place if the anchors' bytes
allow a broadcast, otherwise both sides are dealt by (anchor block, stripe of candidates), so no
task holds more than a few blocks. The first round scores equal labels only and keeps each anchor's
best positives; the second scores all other labels and keeps, for every positive, the best negatives
whose score lies in its band. Tasks keep the best rows of the anchors they saw; Spark merges them.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no
part; a repeated row counts as often as it stands, and as an anchor returns its rows as often; "other"
rows have another id; shorter vectors count as padded by zeros; an anchor without positives, or a
positive without negatives in its band, returns nothing; ties go to the smaller id; scores
beyond 63 bits raise an error; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from closura.session import materialize

GROUP = 8  # dimensions to a byte
CANDIDATES = 4096  # to a block
ANCHORS = 1024  # to a block
SLICE = 256  # candidates scored at once
HELD = 32  # anchor blocks whose best rows a task holds before it hands them over
BROADCAST_BYTES = 32_000_000
STRIPE = 16  # candidate blocks that meet an anchor block in one group of the dealt grid
LOWEST = np.iinfo(np.int64).min

PACKED = "block long, n int, planes int, groups int, ids binary, labels binary, bits binary"
ANCHORED = "a_block int, a_ids binary, a_labels binary, a_values binary"
BEST = "a_block int, a_row int, anchor_id long, positive int, positive_id long, positive_score long, other_id long, score long"


def usable(rows: DataFrame, ident: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label and q (integers ``floor(scale * x)``) of the rows that take part."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(F.col(ident).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~odd)
    whole = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return rows.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("q"))


def _dense(column: pa.ListArray) -> np.ndarray:
    """Rows of integers padded by zeros to the longest, in whole groups."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    width = max(GROUP, math.ceil(int(sizes.max(initial=0)) / GROUP) * GROUP)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _gathered(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors, ``rows`` at a time (all at once if None)."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def joined():
        width = max(q.shape[1] for _, _, q in kept)
        wide = [np.pad(q, ((0, 0), (0, width - q.shape[1]))) for _, _, q in kept]
        return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]), np.concatenate(wide)

    for batch in batches:
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        column = batch.column("q")
        step = rows or max(1, len(ids))
        for at in range(0, len(ids), step):
            kept.append((ids[at : at + step], labels[at : at + step], _dense(column.slice(at, step))))
            if rows and sum(len(k[0]) for k in kept) >= rows:
                yield joined()
                kept = []
    if kept:
        yield joined()


def bit_planes(q: np.ndarray) -> np.ndarray:
    """Bytes [plane, group, row] of integers [row, dimension]; the last plane is the sign."""
    planes = max(int(q.max(initial=0)).bit_length(), int(~q.min(initial=0)).bit_length()) + 1
    n, width = q.shape
    out = np.empty((planes, width // GROUP, n), np.uint8)
    for plane in range(planes):
        bits = ((q >> plane) & 1).astype(np.uint8).reshape(n, width // GROUP, GROUP)
        out[plane] = np.packbits(bits, axis=2, bitorder="little")[:, :, 0].T
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for number, (ids, labels, q) in enumerate(_gathered(batches, CANDIDATES)):
        order = np.lexsort((ids, labels))
        ids, labels, bits = ids[order], labels[order], bit_planes(q[order])
        row = [[(part << 32) + number], [len(ids)], [bits.shape[0]], [bits.shape[1]], [ids.tobytes()], [labels.tobytes()], [bits.tobytes()]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["block", "n", "planes", "groups", "ids", "labels", "bits"])


def _pack_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, labels, q in _gathered(batches, None):
        order = np.lexsort((ids, labels))
        row = [[TaskContext.get().partitionId()], [ids[order].tobytes()], [labels[order].tobytes()], [q[order].tobytes()]]
        types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["a_block", "a_ids", "a_labels", "a_values"])


def subset_sums(values: np.ndarray) -> np.ndarray:
    """Tables [group, subset, anchor]: the sum of each subset of the group's eight dimensions, in the
    narrowest integers that hold any sum over all groups."""
    n, width = values.shape
    most = int(np.abs(values).sum(axis=1).max(initial=0))
    kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
    out = np.zeros((width // GROUP, 1 << GROUP, n), kind)
    for group in range(width // GROUP):
        for j in range(GROUP):
            np.add(out[group, : 1 << j], values[:, group * GROUP + j].astype(kind)[None, :], out=out[group, 1 << j : 2 << j])
    return out


def scores(tables: np.ndarray, bits: np.ndarray, start: int, stop: int, kind) -> np.ndarray:
    """Inner products [candidate, anchor] of candidates ``start`` to ``stop`` by lookups and shifts."""
    total = np.zeros((stop - start, tables.shape[2]), kind)
    for plane in range(bits.shape[0] - 1, -1, -1):
        share = tables[0][bits[plane, 0, start:stop]]
        for group in range(1, min(tables.shape[0], bits.shape[1])):
            share += tables[group][bits[plane, group, start:stop]]
        if plane == bits.shape[0] - 1:
            np.subtract(0, share, out=total, dtype=kind)
        else:
            total <<= 1
            total += share
    return total


class _Anchors:
    """One block of anchors with its tables."""

    def __init__(self, ids: bytes, labels: bytes, values: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.values = np.frombuffer(values, np.int64).reshape(len(self.ids), -1)
        self.tables = subset_sums(self.values)
        self.most = int(np.abs(self.values).sum(axis=1).max(initial=0))

    def kind(self, planes: int):
        bound = self.most << (planes - 1)
        if bound >= 2**62:
            raise ValueError("scores need more than 63 bits; scale the vectors down")
        return np.int32 if bound < 2**31 else np.int64


def _merged(best: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, found: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``keep`` along the last axis by score, then id; LOWEST marks an empty place."""
    if best is not None:
        ids, found = np.concatenate([best[0], ids], axis=-1), np.concatenate([best[1], found], axis=-1)
    order = np.lexsort((ids, -found), axis=-1)[..., :keep]
    return np.take_along_axis(ids, order, -1), np.take_along_axis(found, order, -1)


def _ranked(score: np.ndarray) -> np.ndarray:
    """Candidates of each anchor (rows of the result) by score descending; equal scores keep their order."""
    return np.argsort(-score.T, axis=1, kind="stable")


def _positives(anchors: _Anchors, bits: np.ndarray, ids: np.ndarray, labels: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    out_ids = np.zeros((len(anchors.ids), keep), np.int64)
    out = np.full((len(anchors.ids), keep), LOWEST + 1)
    for label in np.unique(anchors.labels):  # both sides lie in order of their label
        a, b = np.searchsorted(anchors.labels, [label, label + 1])
        c, d = np.searchsorted(labels, [label, label + 1])
        best = None
        for at in range(c, d, SLICE):
            end = min(d, at + SLICE)
            found = scores(anchors.tables[:, :, a:b], bits, at, end, anchors.kind(len(bits))).astype(np.int64)
            found[ids[at:end, None] == anchors.ids[None, a:b]] = LOWEST + 1
            order = _ranked(found)[:, :keep]
            best = _merged(best, ids[at:end][order], np.take_along_axis(found.T, order, 1), keep)
        if best is not None:
            out_ids[a:b, : best[0].shape[1]], out[a:b, : best[1].shape[1]] = best
    return out_ids, out


def _negatives(anchors: _Anchors, bits: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int):
    """For each anchor and positive the best candidates of other labels with low <= score <= high."""
    by_id = np.argsort(ids, kind="stable")
    kind, n = anchors.kind(len(bits)), len(ids)
    found = np.concatenate([scores(anchors.tables, bits, at, min(n, at + SLICE), kind) for at in range(0, n, SLICE)])
    found, sorted_ids, sorted_labels = found[by_id].T, ids[by_id], labels[by_id]
    out_ids = np.zeros((*low.shape, keep), np.int64)
    out = np.full((*low.shape, keep), LOWEST + 1)
    for a in range(len(anchors.ids)):
        bands = np.flatnonzero(low[a] <= high[a])
        if not len(bands):
            continue
        row = found[a]
        there = np.flatnonzero((sorted_labels != anchors.labels[a]) & (row >= low[a][bands].min()) & (row <= high[a][bands].max()))
        there = there[np.argsort(-row[there], kind="stable")]  # equal scores stay in order of their ids
        down = -row[there].astype(np.int64)
        for p in bands:
            first, last = np.searchsorted(down, -high[a, p], "left"), np.searchsorted(down, -low[a, p], "right")
            some = there[first : min(last, first + keep)]
            out_ids[a, p, : len(some)], out[a, p, : len(some)] = sorted_ids[some], row[some]
    return out_ids, out


def _table(block: int, anchors: _Anchors, p_ids, p_scores, ids: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Rows of BEST from arrays [anchor, place] (first round) or [anchor, positive, place]."""
    at = np.argwhere(found > LOWEST + 1)
    a = at[:, 0]
    p = at[:, 1] if found.ndim == 3 else np.zeros(len(at), np.int64)
    none = p_ids is None
    columns = [
        pa.array(np.full(len(at), block), pa.int32()), pa.array(a, pa.int32()), pa.array(anchors.ids[a]), pa.array(p, pa.int32()),
        pa.array(np.zeros(len(at), np.int64) if none else p_ids[a, p]), pa.array(np.zeros(len(at), np.int64) if none else p_scores[a, p]),
        pa.array(ids[tuple(at.T)]), pa.array(found[tuple(at.T)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BEST.split(", ")])


def _grid_task(positives: int, negatives: int, low: int, high: int, second: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def handed_over():
            for block, (anchors, p_ids, p_scores, best) in held.items():
                yield _table(block, anchors, p_ids, p_scores, *best)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                block = row["a_block"]
                if block not in held:
                    if len(held) >= HELD:
                        yield from handed_over()
                    anchors = _Anchors(row["a_ids"], row["a_labels"], row["a_values"])
                    p_ids = p_scores = None
                    if second:
                        p_ids, p_scores = (np.frombuffer(row[c], np.int64).reshape(-1, positives) for c in ("p_ids", "p_scores"))
                    held[block] = [anchors, p_ids, p_scores, None]
                anchors, p_ids, p_scores, best = held[block]
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                bits = np.frombuffer(row["bits"], np.uint8).reshape(row["planes"], row["groups"], row["n"])
                if second:
                    # low * p <= 100 * score <= high * p in whole numbers; no score lies in an empty place's band
                    there = p_scores > LOWEST
                    p = np.where(there, p_scores, 0)
                    found = _negatives(anchors, bits, ids, labels, np.where(there, -((-low * p) // 100), 1), np.where(there, (high * p) // 100, 0), negatives)
                    keep = negatives
                else:
                    found, keep = _positives(anchors, bits, ids, labels, positives), positives
                held[block][3] = _merged(best, *found, keep)
        yield from handed_over()

    return work


def _grid(candidates: DataFrame, anchors: DataFrame, blocks: int, anchor_bytes: int, task) -> DataFrame:
    """Every block of candidates with every block of anchors, scored; the best rows of each task."""
    cells = candidates.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if anchor_bytes <= BROADCAST_BYTES:
        pairs = cells.join(F.broadcast(anchors), "a_block")
    else:
        stripes = max(1, math.ceil(candidates.count() / STRIPE))
        dealt = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        cells = cells.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
        pairs = cells.join(dealt.hint("shuffle_hash"), ["a_block", "stripe"])
    return pairs.mapInArrow(task, BEST)


def _first(best: DataFrame, by: list[str], keep: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other_id")
    return best.withColumn(name, F.row_number().over(order)).where(F.col(name) <= keep)


def _with_positives(anchors: DataFrame, positives: DataFrame, keep: int) -> DataFrame:
    """Each anchor block with its positives' ids and scores, ``keep`` places to an anchor (LOWEST: empty)."""
    listed = positives.groupBy("a_block").agg(F.collect_list(F.struct("a_row", "place", "other_id", "score")).alias("listed"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["a_ids"]) // 8
                ids, found = np.zeros((n, keep), np.int64), np.full((n, keep), LOWEST)
                for r in row["listed"]:
                    ids[r["a_row"], r["place"] - 1], found[r["a_row"], r["place"] - 1] = r["other_id"], r["score"]
                values = [[row[c]] for c in ("a_block", "a_ids", "a_labels", "a_values")] + [[ids.tobytes()], [found.tobytes()]]
                types = [pa.int32(), *[pa.binary()] * 5]
                names = ["a_block", "a_ids", "a_labels", "a_values", "p_ids", "p_scores"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

    return anchors.join(listed, "a_block").mapInArrow(work, f"{ANCHORED}, p_ids binary, p_scores binary")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    ident: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """For the anchors (``is_anchor``, on ``ident``) and each of their first ``positives`` rows of the
    same label, the first ``negatives`` rows of other labels with low % <= score / positive score <= high %."""
    used = usable(rows, ident, label, vector, scale)
    candidates = materialize(used.mapInArrow(_pack, PACKED))
    chosen = usable(rows.where(is_anchor), ident, label, vector, scale)
    n, most = chosen.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ANCHORS))
    anchors = materialize(chosen.repartition(blocks).mapInArrow(_pack_anchors, ANCHORED))
    anchor_bytes = n * 8 * (max(GROUP, most) + 2 + 2 * positives)

    best = _grid(candidates, anchors, blocks, anchor_bytes, _grid_task(positives, negatives, low, high, False))
    best = _first(best, ["a_block", "a_row"], positives, "place")
    ready = materialize(_with_positives(anchors, best, positives))
    best = _grid(candidates, ready, blocks, anchor_bytes, _grid_task(positives, negatives, low, high, True))
    best = _first(best, ["a_block", "a_row", "positive"], negatives, "rank")
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
