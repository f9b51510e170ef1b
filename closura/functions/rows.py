"""Row-local functions on dense ``array<double>`` columns.

Linear-time functions are higher-order expressions inside the JVM. ilr and rank need
a prefix sum and a sort per row, which higher-order functions can only do in quadratic
time; they run as Arrow batches over 2-D numpy arrays.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from closura.dataset import PSEUDOCOUNT


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A Column used twice is evaluated twice, and inside a lambda once per element; a lambda's
    own argument is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rounded(c: Column, digits: int) -> Column:
    """``F.round`` of doubles without a decimal for each number, as DuckDB rounds; for tables of as many rows as cells."""
    unit = F.lit(10.0**digits)
    near = F.signum(c) * F.floor(F.abs(c) * unit + 0.5).cast("double") / unit + F.lit(0.0)
    return F.when(F.abs(c) < 1e6, near).otherwise(F.round(c, digits))


def sorted_entries(entries: Column) -> Column:
    return F.coalesce(F.sort_array(entries), F.array().cast("array<struct<pos:int,value:double>>"))


def lay_out(s: Column, width: Column, fill: Column | None = None) -> Column:
    """Sorted sparse (pos, value) structs -> array<double> of ``width``, in linear time: the
    entries with runs of ``fill`` (default 0) between them. ``s`` must be a plain column or a
    lambda argument, since it is read once per entry."""
    blank = F.lit(0.0) if fill is None else fill

    def cell(e: Column, j: Column) -> Column:
        nxt = F.coalesce(F.try_element_at(s, j + 2)["pos"], width)
        return F.concat(F.array(e["value"]), F.array_repeat(blank, (nxt - e["pos"] - 1).cast("int")))

    lead = F.coalesce(F.try_element_at(s, F.lit(1))["pos"], width)
    return F.concat(F.array_repeat(blank, lead.cast("int")), F.flatten(F.transform(s, cell)))


def dense(entries: Column, width: Column, fill: Column | None = None) -> Column:
    """``lay_out`` of unsorted entries."""
    return let(sorted_entries(entries), lambda s: lay_out(s, width, fill))


def pseudocount(x: Column, eps: float = PSEUDOCOUNT) -> Column:
    return F.transform(x, lambda v: F.when(v == 0, F.lit(eps)).otherwise(v))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def clr(x: Column) -> Column:
    def centre(logs: Column) -> Column:
        return let(array_sum(logs) / F.size(logs), lambda m: F.transform(logs, lambda v: v - m))

    return let(F.transform(x, F.ln), centre)


def _by_width(xs: pd.Series, fn) -> pd.Series:
    """Apply a matrix function to the rows of equal width in an Arrow batch; NULL stays NULL."""
    out = np.empty(len(xs), dtype=object)
    arrays = xs.to_numpy()
    widths = np.array([-1 if x is None else len(x) for x in arrays])
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        if w < 0:
            continue
        block = fn(np.concatenate(arrays[rows]).astype(float).reshape(len(rows), w))
        for r, row in zip(rows, block):
            out[r] = row
    return pd.Series(out)


def _ilr_block(m: np.ndarray) -> np.ndarray:
    if m.shape[1] < 2:
        return np.empty((m.shape[0], 0))
    logs = np.log(m)
    i = np.arange(1, m.shape[1])
    return np.sqrt(i / (i + 1)) * (np.cumsum(logs, axis=1)[:, :-1] / i - logs[:, 1:])


def _rank_block(m: np.ndarray) -> np.ndarray:
    """Descending ranks along the rows; ties get their mean, NaN stays."""
    order = np.argsort(-m, axis=1, kind="stable")  # NaN comes last
    v = np.take_along_axis(m, order, 1)
    at = np.arange(m.shape[1])
    first, last = np.ones((2, *m.shape), bool)
    first[:, 1:] = last[:, :-1] = v[:, 1:] != v[:, :-1]
    begin = np.maximum.accumulate(np.where(first, at, 0), axis=1)
    end = np.minimum.accumulate(np.where(last, at, m.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (begin + end) / 2 + 1, 1)
    out[np.isnan(m)] = np.nan
    return out


# pandas_udf reads the type hints, which must be real classes here (no string annotations)
def _ilr(xs):
    return _by_width(xs, _ilr_block)


def _rank(xs):
    return _by_width(xs, _rank_block)


for _f in (_ilr, _rank):
    _f.__annotations__ = {"xs": pd.Series, "return": pd.Series}

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package
# declared nondeterministic so that no rule copies a call into an inferred filter
ilr = F.pandas_udf(_ilr, ArrayType(DoubleType())).asNondeterministic()
rank_row = F.pandas_udf(_rank, ArrayType(DoubleType())).asNondeterministic()


def alr(x: Column, denom: Column | int) -> Column:
    """Plain ratios to the element at 0-based ``denom``, which is removed (no logarithm)."""
    d = denom if isinstance(denom, Column) else F.lit(denom)

    def ratios(r: Column) -> Column:
        over = let(F.element_at(r, d.cast("int") + 1), lambda v: F.transform(r, lambda e: e / v))
        return F.filter(over, lambda _, i: i != d)

    return let(x, ratios)


def alr_log(x: Column, denom: Column | int) -> Column:
    return F.transform(alr(x, denom), F.ln)


def presence_absence(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(v != 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def one_hot(value: Column, universe: list[str]) -> Column:
    """Drop-first indicator array over a sorted level list; NULL and unknown give zeros."""
    if len(universe) < 2:
        return F.array().cast("array<double>")
    return F.transform(F.lit(list(universe[1:])), lambda c: F.when(value.cast("string").eqNullSafe(c), 1.0).otherwise(0.0))


def softmax(x: Column) -> Column:
    def scaled(e: Column) -> Column:
        return let(array_sum(e), lambda t: F.transform(e, lambda v: v / t))

    def shifted(r: Column) -> Column:
        return let(F.array_max(r), lambda m: F.transform(r, lambda v: F.exp(v - m)))

    return let(let(x, shifted), scaled)


def argmax(x: Column) -> Column:
    """0-based position of the first maximum."""
    return let(x, lambda r: F.array_position(r, F.array_max(r)) - 1).cast("int")


def _running_product(x: Column) -> Column:
    """Prefix products; the arrays here hold one entry per ordinal level."""
    start = F.array().cast("array<double>")
    return F.aggregate(
        x, start, lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(1.0)) * v))
    )


def corn_conditional(logits: Column) -> Column:
    """P(y > k) for each threshold: running product of sigmoids."""
    return _running_product(F.transform(logits, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))


def corn_proba(logits: Column) -> Column:
    """Class probabilities from conditional logits: differences of 1, P(y>0), ..., 0."""
    c = F.concat(F.array(F.lit(1.0)), corn_conditional(logits), F.array(F.lit(0.0)))
    return let(c, lambda b: F.transform(
        F.slice(b, 1, F.size(b) - 1), lambda v, i: F.greatest(v - F.element_at(b, i + 2), F.lit(0.0))))


def corn_label(logits: Column) -> Column:
    return F.size(F.filter(corn_conditional(logits), lambda p: p > 0.5))


def epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))
