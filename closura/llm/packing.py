"""Token ids packed into rows of fixed length by best-fit-decreasing.

Each task encodes its documents, ends each with an end-of-text id, cuts documents longer than a row
into full rows and a rest, and packs the pieces of about ``CHUNK_TOKENS`` tokens at a time: longest
first, each into the open row with the least room that still holds it, found in a segment tree over
room. Nothing is shuffled, memory is bounded by a chunk and the longest document, and a lost task is
redone from its input alone. Pieces carry their document and first token, so documents are
recovered exactly.

A packed row holds ``ids`` and ``positions`` (little-endian, 32 bits each, ``length`` values, pads
after ``n_tokens``), ``cu_seqlens`` (cumulative segment lengths from 0), ``doc_ids`` and ``starts``
(first token of each segment in its document). Positions count from the start of the document's
segment, that is, they reset to 0 at each value of ``cu_seqlens`` but the last.

Defined results: null and empty texts are the end-of-text id alone; null doc_id stays null in
``doc_ids``; repeated rows are packed each; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import functools
import itertools
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from closura.llm.bpe import read_ranks, texts_of

LENGTH = 2048
CHUNK_TOKENS = 4_000_000
SCHEMA = "pack_id bigint, n_tokens int, doc_ids array<bigint>, starts array<int>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """Open rows by room left; finds the least room of at least n in log(length) steps."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.some = bytearray(2 * self.leaves)  # does any row below this node exist?
        self.rows: defaultdict[int, list[int]] = defaultdict(list)

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        node = need + self.leaves
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):  # up, until a right sibling has rows
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            while node and not (node < self.leaves and (self.some[2 * node] or self.some[2 * node + 1])):
                self.some[node] = 0
                node >>= 1
        return room, row


def best_fit(sizes: Sequence[int], length: int) -> list[list[int]]:
    """Indices of the pieces in each row; sizes are between 1 and ``length``."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


class Encoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.ranks = read_ranks(path)
        self.model = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        return (array("I", self.model.encode_ordinary(text)).tobytes() for text in texts)


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def pack_rows(pieces: list[tuple[int | None, int, np.ndarray]], length: int, pad: int, first: int) -> pa.RecordBatch:
    """pieces: document, first token, ids."""
    rows = best_fit([len(p[2]) for p in pieces], length)
    columns: list[list] = [[] for _ in range(7)]
    for k, members in enumerate(rows):
        chosen = [pieces[i] for i in members]
        sizes = [len(p[2]) for p in chosen]
        ids, positions = np.full(length, pad, np.uint32), np.zeros(length, np.uint32)
        cu = [0, *itertools.accumulate(sizes)]
        ids[: cu[-1]] = np.concatenate([p[2] for p in chosen])
        positions[: cu[-1]] = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
        values = (first + k, cu[-1], [p[0] for p in chosen], [p[1] for p in chosen], cu, ids.tobytes(), positions.tobytes())
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def pack(
    docs: DataFrame, path: str, pattern: str, eot: int, length: int = LENGTH, chunk_tokens: int = CHUNK_TOKENS,
    ident: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Packed rows of all documents; pack_id is unique, in the manner of monotonically_increasing_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = load(path, pattern), np.array([eot], np.uint32).tobytes()
        task = TaskContext.get()
        made = (task.partitionId() if task else 0) << 33
        pieces, waiting = [], 0
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.encode(texts_of(batch.column(1))), strict=True):
                ids = np.frombuffer(raw + end, np.uint32)
                pieces += [(doc, at, ids[at : at + length]) for at in range(0, len(ids), length)]
                waiting += len(ids)
                if waiting >= chunk_tokens:
                    yield (out := pack_rows(pieces, length, eot, made))
                    made += out.num_rows
                    pieces, waiting = [], 0
        if pieces:
            yield pack_rows(pieces, length, eot, made)

    return docs.select(ident, text).mapInArrow(run, SCHEMA)
