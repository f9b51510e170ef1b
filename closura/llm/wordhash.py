"""Hashes of the words of many texts at once, over numpy arrays.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and return, with A-Z
lower-cased. A word's hash is a sum over its bytes of a random 64-bit value for the byte times a power
of an odd number for its place, then mixed; equal words get equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20_240_917))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts of a batch as bytes, some at a time, so that the arrays of a slice stay small (a text is never cut)."""
    some, size = [], 0
    for at in range(0, len(column), 256):
        for data in column.slice(at, 256).cast(pa.binary()).to_pylist():
            some.append(data or b"")
            size += len(some[-1])
            if size >= limit:
                yield some
                some, size = [], 0
    if some:
        yield some


def hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (int64) of all words in order, and the index at which each text's words begin, with the total at the end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    word = ~_SPACE[data]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.int64), bounds
    sizes = ends - starts
    powers = np.full(int(sizes.max()), _PLACE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _VALUE[data[word]] * powers[at]
    return mix(np.add.reduceat(values, first)).view(np.int64), bounds
