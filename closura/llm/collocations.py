"""Phrase collocations by SON partitioning: shards mined completely at a lowered support, candidates counted exactly.

1. Documents are dealt to ``shards`` shards by a hash. Each shard is mined completely: tasks count the
   64-bit hashes of all its phrases of one to ``longest`` words and send sorted arrays of distinct hashes and
   counts, cut into buckets by the leading bits. A phrase found ``support`` times in all stands at least
   support / shards times in one shard, so that is each shard's support, and the union over shards of its
   phrases holds every frequent one. A bucket holds all shards' counts, so candidates of too small a
   sum go at once. Equal hashes of unlike phrases only add candidates.
2. The candidates' bits make a filter of fixed size. A second reading counts every phrase that passes it by its
   words: chunks of text group occurrences by 128 bits, emit each phrase once with its count, and Spark
   sums by (lang, phrase). What passed wrongly falls below the support.

A shard is a set of documents, not a task: any number of tasks read it, and its counts meet in buckets
whose number follows the size of the corpus. Phrases that fill a third of all rows are one entry a task.

Scores are computed in decimals. The lowest cut counts; a candidate lying inside a longer one that takes
over enough of its occurrences goes.

Defined results: null text is empty; null lang is ``und``; repeated rows count as often as they stand;
a piece with fewer words than a phrase holds none; ties rank by phrase in byte order; very long
texts are read whole (a text is the least that a task holds); empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from closura.llm.wordhash import mix
from closura.session import materialize

# Fixed values of the task's rule.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \x09"
NO_LANG = "und"
SCALE = 1_000_000

SHARDS = 5
CHUNK_BYTES = 12_000_000  # text that waits to be grouped by shard and language
WORDS = 50_000  # hashed at once
PENDING = 6_000_000  # hashes that a task holds before it counts and sends them
BUCKET_BYTES = 8_000_000  # of text to a bucket of hashes
FILTER_BITS = 27  # log2 of the filter's bits: 16 MB
TOP_SALT = 64

_rng = np.random.Generator(np.random.PCG64(11_13))
_VALUES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_PLACES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = _BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Chunk:
    """The words of some texts of one language."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        breaks = _BREAK[self.data]
        self.word = ~(breaks | _BLANK[self.data])
        edge = np.flatnonzero(self.word[1:] != self.word[:-1]) + 1
        if self.word[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.sizes = edge[::2], edge[1::2] - edge[::2]
        self.piece = np.cumsum(breaks, dtype=np.int32)[self.starts]
        self.seed = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=16).digest(), np.uint64)

    def hashes(self, which: int, longest: int) -> list[np.ndarray]:
        """For 1 to ``longest`` words, the hash of the phrase that begins at each word (as far as there are words)."""
        if not len(self.starts):
            return [np.zeros(0, np.uint64)] * longest
        powers = np.full(int(self.sizes.max()), _PLACES[which])
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        single = np.empty(len(self.starts), np.uint64)
        for begin in range(0, len(single), WORDS):
            starts, sizes = self.starts[begin : begin + WORDS], self.sizes[begin : begin + WORDS]
            text = slice(starts[0], starts[-1] + sizes[-1])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
            values = _VALUES[which][self.data[text][self.word[text]]] * powers[at]
            single[begin : begin + WORDS] = mix(np.add.reduceat(values, first) ^ self.seed[which])
        out = [single]
        for more in range(1, longest):
            out.append(mix(out[-1][: len(single) - more] * _PLACES[1 - which] + single[more:]))
        return out

    def within(self, words: int) -> np.ndarray:
        """Words at which a phrase of ``words`` words begins that lies in one piece."""
        last = max(0, len(self.starts) - words + 1)
        return np.flatnonzero(self.piece[:last] == self.piece[words - 1 :])

    def phrases(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of ``words`` words that begin ``at``, joined by single blanks."""
        index = (at[:, None] + np.arange(words)[None, :]).ravel()
        sizes = self.sizes[index] + 1  # and a blank
        ends = np.cumsum(sizes)
        source = np.repeat(self.starts[index] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = self.data[np.minimum(source, len(self.data) - 1)]
        data[ends - 1] = ord(" ")
        keep = np.ones(len(data), bool)
        keep[ends[words - 1 :: words] - 1] = False  # no blank after the last word
        offsets = np.concatenate([[0], ends[words - 1 :: words] - np.arange(1, len(at) + 1)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))


def chunks(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[int, Chunk]]:
    """Shard and texts of one shard and language at a time; a text is never cut. Once more than ``limit``
    bytes wait, the most that wait together go."""
    limit = CHUNK_BYTES if limit is None else limit
    waiting: dict[tuple[int, str], list[bytes]] = {}
    sizes: dict[tuple[int, str], int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for shard, lang, text in zip(part.column("shard").to_pylist(), part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                waiting.setdefault((shard, lang), []).append(text)
                sizes[shard, lang] = sizes.get((shard, lang), 0) + len(text) + 1
                if sum(sizes.values()) >= limit:
                    key = max(sizes, key=sizes.get)
                    del sizes[key]
                    yield key[0], Chunk(key[1], waiting.pop(key))
    for (shard, lang), texts in waiting.items():
        yield shard, Chunk(lang, texts)


def _distinct(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and how often they stand (or the sums of their counts)."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64)
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    if counts is None:
        return hashes[first], np.diff(np.append(first, len(hashes)))
    return hashes[first], np.add.reduceat(counts, first)


def _mine(longest: int, bucket_bits: int):
    """Distinct hashes of all phrases with their counts, by (bucket, shard)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def sent():
            types = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            for shard in list(held):
                rows: dict[str, list] = {"bucket": [], "shard": [], "hashes": [], "counts": []}
                hashes, counts = _distinct(np.concatenate(held.pop(shard)))
                edges = np.searchsorted(hashes, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits)) if bucket_bits else np.zeros(1, np.int64)
                edges = np.append(edges, len(hashes))
                for bucket in np.flatnonzero(np.diff(edges)):
                    part = slice(edges[bucket], edges[bucket + 1])
                    for name, value in zip(rows, (int(bucket), shard, hashes[part].tobytes(), counts[part].astype(np.uint32).tobytes())):
                        rows[name].append(value)
                for at in range(0, len(rows["bucket"]), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(v[at : at + 256], t) for v, t in zip(rows.values(), types)], names=list(rows))

        for shard, chunk in chunks(batches):
            held.setdefault(shard, []).extend(h[chunk.within(n)] for n, h in enumerate(chunk.hashes(0, longest), 1))
            if sum(len(h) for some in held.values() for h in some) >= PENDING:
                yield from sent()
        yield from sent()

    return work


def _candidates(local: int, support: int, bucket_bits: int, filter_bits: int):
    """The filter's part of one bucket: bits of the phrases frequent in some shard and often enough in all."""

    def work(table: pa.Table) -> pa.Table:
        frequent, every = [], []
        shards = table.column("shard").to_numpy()
        for shard in np.unique(shards):
            part = table.filter(pa.array(shards == shard))
            hashes, counts = (np.concatenate([np.frombuffer(b, kind) for c in part.column(name).chunks for b in c.to_pylist()]) for name, kind in (("hashes", np.uint64), ("counts", np.uint32)))
            hashes, counts = _distinct(hashes, counts.astype(np.int64))
            frequent.append(hashes[counts >= local])
            every.append((hashes, counts))
        union = _distinct(np.concatenate(frequent))[0]
        total = np.zeros(len(union), np.int64)
        for hashes, counts in every:
            at = np.minimum(np.searchsorted(hashes, union), len(hashes) - 1)
            total += np.where(hashes[at] == union, counts[at], 0)
        union = union[total >= support]
        low = filter_bits - bucket_bits
        bits = np.zeros(1 << low, bool)
        bits[((union >> np.uint64(64 - filter_bits)) & np.uint64((1 << low) - 1)).astype(np.int64)] = True
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), "n": pa.array([len(union)], pa.int64())})

    return work


def candidate_filter(docs: DataFrame, support: int, longest: int, shards: int, filter_bits: int = FILTER_BITS) -> bytes:
    """Bits by the leading bits of a phrase's hash; set for every phrase of ``docs`` (lang, text) found ``support`` times."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bucket_bits = min(filter_bits - 3, max(4, math.ceil(math.log2(size / BUCKET_BYTES + 1))))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    found = dealt.mapInArrow(_mine(longest, bucket_bits), "bucket int, shard int, hashes binary, counts binary")
    parts = found.groupBy("bucket").applyInArrow(_candidates(math.ceil(support / shards), support, bucket_bits, filter_bits), "bucket int, bits binary, n long")
    width = (1 << filter_bits - bucket_bits) // 8
    whole = bytearray((1 << filter_bits) // 8)
    for row in parts.select("bucket", "bits").toLocalIterator():  # in all as many bytes as the filter has
        whole[row["bucket"] * width : (row["bucket"] + 1) * width] = row["bits"]
    return bytes(whole)


def _count(longest: int, filter_bits: int, filtered):
    """lang, words, phrase, f: of each chunk the phrases that pass the filter; words 0 counts the words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filtered.value, np.uint8)
        for _, chunk in chunks(batches):
            one, two = chunk.hashes(0, longest), chunk.hashes(1, longest)
            yield _rows(chunk.lang, 0, pa.nulls(1, pa.string()), np.array([len(chunk.starts)]))
            for n in range(1, longest + 1):
                at = chunk.within(n)
                place = one[n - 1][at] >> np.uint64(64 - filter_bits)
                at = at[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                a, b = one[n - 1][at], two[n - 1][at]
                order = np.argsort(a)
                a, b = a[order], b[order]
                if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
                    order = np.lexsort((two[n - 1][at], one[n - 1][at]))
                    a, b = one[n - 1][at][order], two[n - 1][at][order]
                first = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                counts = np.diff(np.append(first, len(a)))
                for some in range(0, len(first), 100_000):
                    part = slice(some, some + 100_000)
                    yield _rows(chunk.lang, n, chunk.phrases(at[order[first[part]]], n), counts[part])

    return work


def _rows(lang: str, words: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.repeat(lang, n).cast(pa.string()), pa.repeat(pa.scalar(words, pa.int32()), n), phrases, pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "phrase", "f"])


def phrase_counts(docs: DataFrame, support: int, longest: int, shards: int = SHARDS, lang: str = "lang", text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Written: lang, words, phrase, f of every phrase of 1 to ``longest`` words with f >= support; words 0: all words."""
    used = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    filtered = docs.sparkSession.sparkContext.broadcast(candidate_filter(used, support, longest, shards, filter_bits))
    counted = used.withColumn("shard", F.lit(0)).mapInArrow(_count(longest, filter_bits, filtered), "lang string, words int, phrase string, f long")
    return materialize(counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= support)))


def scored(counts: DataFrame) -> DataFrame:
    """Per candidate (two words and more): lang, words, phrase, a and l, r, score of its lowest cut."""
    known = counts.where("words > 0").select("lang", "phrase", "f")
    parts = F.split("phrase", " ")
    cuts = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    left, right = F.slice("parts", F.lit(1), F.col("k")), F.slice("parts", F.col("k") + 1, F.col("words"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.array_join(left, " ").alias("left"), F.array_join(right, " ").alias("right"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * cast({SCALE} as decimal(38, 0))) div ({wide('l')} * {wide('r')})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def taken_over(counts: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of the candidates inside a longer one with 100 * f(longer) >= percent * f."""
    longer = counts.where("words > 2").select("lang", "f", "words", F.split("phrase", " ").alias("parts"))
    inner = longer.select("lang", "f", "words", "parts", F.explode(F.expr("sequence(2, words - 1)")).alias("n"))
    inner = inner.select("lang", "f", "n", "parts", F.explode(F.expr("sequence(1, words - n + 1)")).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("parts", F.col("at"), F.col("n")), " ").alias("phrase"), "f")
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    shorter = counts.where("words > 1").select("lang", "phrase", "f")
    return shorter.join(most, ["lang", "phrase"]).where(100 * F.col("most") >= percent * F.col("f")).select("lang", "phrase")


def collocations(
    docs: DataFrame, support: int = 10, longest: int = 3, percent: int = 50, top: int = 2000, shards: int = SHARDS, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Each language's first ``top`` candidates: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, support, longest, shards, lang, text)
    ranked = materialize(scored(counts).join(taken_over(counts, percent), ["lang", "phrase"], "left_anti"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within parts of a language, then over what they leave: no task sorts a whole language
    part = F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALT))
    ranked = ranked.withColumn("r0", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("r0") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
