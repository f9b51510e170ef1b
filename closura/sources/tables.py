"""Readers and writers. Tables are tab-separated text or parquet."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from closura.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIRECTIVE = "#q2:"


def _first_as_id(df: DataFrame) -> DataFrame:
    first = df.columns[0]
    return df.withColumnRenamed(first, "sample_id").withColumn("sample_id", F.col("sample_id").cast("string"))


def read_metadata(spark: SparkSession, path: str, schema: StructType | None = None, directives: bool = False) -> DataFrame:
    """Samples as rows; the first column is the id and stays text. Types of the others come from
    ``schema`` or are inferred.

    ``directives`` drops ``#q2:`` rows before types are inferred: they would turn every column
    into text."""
    reader = spark.read.option("sep", "\t").option("header", True)
    if schema is not None:
        df = reader.schema(schema).csv(path)
        return _first_as_id(df).where(~F.col("sample_id").startswith(DIRECTIVE)) if directives else _first_as_id(df)
    text = _first_as_id(reader.csv(path))
    return _typed(text.where(~F.col("sample_id").startswith(DIRECTIVE)) if directives else text)


def _typed(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest of bigint, double, string that loses nothing: one pass."""
    cols = [c for c in df.columns if c != "sample_id"]
    if not cols:
        return df
    fits = {(c, t): F.expr(f"bool_and(`{c}` IS NULL OR try_cast(`{c}` AS {t}) IS NOT NULL)") for c in cols for t in ("bigint", "double")}
    row = df.agg(*[e.alias(f"{i}") for i, e in enumerate(fits.values())]).first()
    ok = dict(zip(fits, row))
    kind = {c: next((t for t in ("bigint", "double") if ok[(c, t)]), "string") for c in cols}
    return df.select("sample_id", *[F.col(f"`{c}`").cast(kind[c]).alias(c) for c in cols])


def _numeric(df: DataFrame, keep: str) -> list[str]:
    return [c for c in df.columns if c != keep]


def _long(df: DataFrame, keep: str, variable: str) -> DataFrame:
    cols = _numeric(df, keep)
    as_double = df.select(keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return as_double.unpivot([keep], [F.col(f"`{c}`") for c in cols], variable, "value").where("value <> 0")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), '^"(.*)"$', "$1")


def _cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(row id, at, text) of every cell and (at, name) of every column, from the lines of a table: as many rows as
    cells, so that the number of columns is no matter for the plan. The header is the line that stands first in the files,
    whichever task reads first; repeated header lines are dropped."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", F.sha2("value", 256).alias("digest"), place.alias("place"))
    top = lines.agg(F.min_by("digest", "place")).first()[0]
    if top is None:
        return spark.createDataFrame([], "id string, at int, text string"), spark.createDataFrame([], "at int, name string")
    head = F.col("digest") == top
    names = lines.where(head).select(F.posexplode(F.split("value", "\t")).alias("at", "name")).distinct()
    names = names.select((F.col("at") - 1).alias("at"), _plain(F.col("name")).alias("name")).where("at >= 0")
    rows = lines.where(~head & (F.col("value") != "")).select(F.split("value", "\t").alias("row"))
    cells = rows.select(_plain(F.col("row")[0]).alias("id"), F.posexplode(F.slice("row", F.lit(2), F.size("row"))).alias("at", "text"))
    return cells.select("id", "at", _plain(F.col("text")).alias("text")), materialize(names)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, file, block, line, at, text of the cells of a task's blocks; ``key`` tells the file, which is named now and then.

    ``line`` counts the lines that begin in the block from 1 on; 0 goes on with a line of an earlier block, and ``at`` counts
    its cells from the block's start. A line's first cell is at 0."""
    here, line, at = None, 0, 0
    for batch in batches:
        blocks, files = batch.column("block").to_numpy(), batch.column("key").to_numpy()
        turns = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        for begin, end in zip([0, *turns], [*turns, batch.num_rows]):
            if begin == end:
                continue
            some = batch.slice(begin, end - begin)
            where = (int(files[begin]), some.column("file")[0].as_py(), int(blocks[begin]))
            fresh = where != here
            if fresh:
                here, line, at = where, 0, 0
            top = fresh and where[2] == 0
            text = some.column("text")
            broken = np.flatnonzero(pc.match_substring_regex(text, "[\r\n]").to_numpy(zero_copy_only=False))
            if top and not (len(broken) and broken[0] == 0):
                broken = np.concatenate([[0], broken])  # a file begins with a line
            begins = np.zeros(len(text), np.int64)
            begins[broken] = 1
            lines = line + np.cumsum(begins)
            last = np.maximum.accumulate(np.where(begins == 1, np.arange(len(text)), -1))
            place = np.where(last >= 0, np.arange(len(text)) - last, at + np.arange(len(text)))
            tails, heads = [], text
            if len(broken):
                pieces = [re.split("\r\n|\r|\n", text[int(i)].as_py()) for i in broken]
                heads = np.array(text.to_pylist(), dtype=object)
                heads[broken] = [p[-1] for p in pieces]
                heads = pa.array(heads, pa.string())
                for i, p in zip(broken, pieces):
                    before = (int(lines[i - 1]), int(place[i - 1]) + 1) if i else (line, at)
                    if len(p) > 1 and not (top and i == 0):
                        tails.append((*before, p[0]))
            line, at = int(lines[-1]), int(place[-1]) + 1
            yield _located(where, lines, place, heads)
            if tails:
                yield _located(where, [t[0] for t in tails], [t[1] for t in tails], pa.array([t[2] for t in tails], pa.string()))


def _located(where: tuple[int, str, int], lines, place, text: pa.Array) -> pa.RecordBatch:
    n = len(text)
    named = pa.array([where[1], *[None] * (n - 1)], pa.string())
    columns = [pa.array(np.full(n, where[0])), named, pa.array(np.full(n, where[2])), pa.array(lines, pa.int64()), pa.array(place, pa.int64()), text]
    return pa.RecordBatch.from_arrays(columns, ["key", "file", "block", "line", "at", "text"])


def _cells_of_long_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, at, text of every cell, written: files are read cell by cell and not line by line, so that a line may be longer than
    a task can hold and is shared by as many tasks as it has blocks. Lines count on from file to file."""
    cells = spark.read.option("lineSep", "\t").text(path)
    cells = cells.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))
    cells = cells.select(F.xxhash64("file").alias("key"), "*")
    parts = materialize(cells.mapInArrow(_placed, "key long, file string, block long, line long, at long, text string"))
    # one row for each block of the files
    ends = parts.groupBy("key", "block").agg(F.max("file").alias("file"), F.max(F.struct("line", "at")).alias("end")).orderBy("file", "block").collect()
    starts, lines, at = [], 0, 0
    for r in ends:
        starts.append((r["key"], r["block"], lines, at))
        lines, at = lines + r["end"]["line"], r["end"]["at"] + 1 + (at if r["end"]["line"] == 0 else 0)
    start = materialize(spark.createDataFrame(starts, "key long, block long, before long, carried long"))
    goes_on = F.when(F.col("line") == 0, F.col("carried")).otherwise(0)
    return parts.join(start, ["key", "block"]).select((F.col("before") + F.col("line")).alias("line"), (F.col("at") + goes_on).alias("at"), "text")


def read_features_wide(spark: SparkSession, path: str) -> DataFrame:
    """Samples as rows, features as columns -> (sample_id, feature_id, value), non-zero only. Blank cells are
    zeros; other text is an error. Any number of columns: rows are split and exploded by position."""
    cells, names = _cells(spark, path)
    value = F.when(F.col("text") != "", F.col("text").cast("double"))
    valued = cells.select(F.col("id").alias("sample_id"), "at", value.alias("value")).where("value <> 0")
    return valued.join(names, "at").select("sample_id", F.col("name").alias("feature_id"), "value")


def melt_wide(df: DataFrame) -> DataFrame:
    return _long(df, "sample_id", "feature_id")


def read_features_tall(spark: SparkSession, path: str) -> DataFrame:
    """Features as rows, samples as columns, a comment line on top -> the same long form. Any number of samples: no
    task holds a whole line.

    The comment stands before the header and holds no tab; every later line does. The header may
    start with ``#`` too. Blank cells are zeros."""
    cells = _cells_of_long_lines(spark, path)
    top = cells.where("at > 0").agg(F.min("line")).first()[0]  # the first line that holds a tab
    first = materialize(cells.where("at = 0").select("line", "text"))
    same = first.join(first.where(F.col("line") == top).select("text"), "text").select("line")
    if same.count() > 1:  # lines that begin as the header does may be the header once more
        whole = cells.join(same, "line").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("at", "text").cast("decimal(38,0)")).alias("digest"))
        again = whole.join(whole.where(F.col("line") == top).select("n", "digest"), ["n", "digest"]).select("line")
        first = first.join(again, "line", "left_anti")
    else:
        first = first.where(F.col("line") != top)
    names = cells.where((F.col("line") == top) & (F.col("at") > 0)).select("at", _plain(F.col("text")).alias("sample_id"))
    value = F.expr("try_cast(text AS double)").alias("value")
    valued = cells.where("at > 0").select("line", "at", _plain(F.col("text")).alias("text")).select("line", "at", value).where("value <> 0")
    valued = valued.join(first.select("line", _plain(F.col("text")).alias("feature_id")), "line")
    return valued.join(names, "at").select("sample_id", "feature_id", "value")


def read_taxonomy(spark: SparkSession, path: str, prefix: str = "F") -> DataFrame:
    """feature_id (prefixed), taxon, confidence."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = {re.sub(r"\W", "", c).lower(): c for c in raw.columns[1:]}
    conf = F.col(f"`{names['confidence']}`").cast("double") if "confidence" in names else F.lit(None).cast("double")
    return raw.select(
        F.concat(F.lit(prefix), F.col(f"`{raw.columns[0]}`")).alias("feature_id"),
        F.col(f"`{names['taxon']}`").alias("taxon"),
        conf.alias("confidence"),
    )


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split, so that reading one split never touches the other."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Metric and importance tables."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
