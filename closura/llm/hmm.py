"""A hidden Markov language model trained by Baum-Welch on Spark.

Tokens are words with A-Z lower-cased, and one end after each text. ``vocabulary`` counts the
training tokens of all documents. Every training word is emitted by the states with counts of its
own; unknown words share one symbol "other". A state's emission of a word is its expected count plus
one, the one dealt to the states by their share of all tokens: states agree on words seen once or
never as add-one counts do. That makes the model a proper distribution over all texts.

Texts are coded once, in chunks of ``CHUNK`` bytes: the ``SYMBOLS`` most frequent words by rank, a chunk's
other words by their place in its own list. Each round every task runs the scaled forward and backward
recursions over its chunks and yields expected counts. Those of the frequent words, of fixed size,
are summed to the driver and go to all tasks. Those of all other words are dealt into buckets by
hash, summed there, and each chunk gets the sums of its words back, so that no task or driver holds
the whole vocabulary; words of a single chunk keep theirs. They move as whole numbers of parts of one
(``UNIT``), packed, with places in the bucket instead of hashes; the model is that of the numbers that
moved, so its emissions still sum to one. For training a text is cut into segments of ``SEGMENT``
tokens, with start probabilities of their own for first and later ones, so that many segments advance
together; rounds end once the log-likelihood gains less than ``GAIN`` of itself. Scoring runs the forward recursion
over whole texts.

Defined results: null text is empty (the end alone); null doc_id trains, like every id not held out;
repeated rows each count and are scored each; words of equal count share the last ranks in the order of their hashes; very
long texts are trained in segments and scored whole; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.llm import wordhash
from closura.session import materialize, release

SYMBOLS = HEAD = 16_384
STATES = 8
ROUNDS = 50  # at most; GAIN ends them
GAIN = 1e-3
SEGMENT = 64
CHUNK = 12 * wordhash.SLICE_BYTES  # of text; the larger, the fewer chunks a word stands in
UNIT = 1_024  # expected counts of words beyond the symbols move as whole numbers of this part of one
BUCKET_WORDS = 200_000  # of all chunks' lists, in a bucket
SPREAD_WORDS = 2_000  # the same, if there are few
STRIPE = 512  # symbols that are summed together
LEVELS = 16  # of counts per power of two, to find the most frequent words
END = np.int64(0x656E64)  # stands for the end of a text among the word hashes
BATCH_SEGMENTS = 4_096


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Head:
    """The most frequent training words, hashes ascending: ``rank`` by count, ``count``."""

    word: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    symbols: int

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places in ``word``, -1 where missing."""
        if not len(self.word):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        return np.where(self.word[at] == words, at, -1)


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Written counts (word, c) of all tokens, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashed, sizes in hashed_chunks(batch.column(0), 8 * wordhash.SLICE_BYTES):
                words, counts = np.unique(hashed, return_counts=True)
                columns = [np.append(words, END), np.append(counts, len(sizes))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["word", "c"])

    return materialize(docs.select(text).mapInArrow(count, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")))


def head_of(vocab: DataFrame, size: int = HEAD, symbols: int = SYMBOLS) -> tuple[Head, int]:
    """The words of at least a least count, ``size`` at most; and that count."""
    level = F.floor(F.log2("c") * LEVELS)
    levels = vocab.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()
    taken, least = 0, None
    for row in sorted(levels, key=lambda r: -r["level"]):
        taken += row["words"]
        if taken > size:
            break
        least = row["least"]
    if least is None:
        empty = np.zeros(0, np.int64)
        return Head(empty, empty, empty, 0), 2**62
    rows = vocab.where(F.col("c") >= least).toPandas()
    word, count = rows["word"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)
    order = np.lexsort((word, -count, word == END))  # the end is no symbol of its own here: last
    rank = np.empty(len(word), np.int64)
    rank[order] = np.arange(len(word))
    rank[word == END] = 2**40
    by = np.argsort(word)
    return Head(word[by], rank[by], count[by], min(symbols, len(word) - int((word == END).any()))), least


def packed(numbers: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers byte plane by byte plane, compressed: corpus and counts move once in every round."""
    planes = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if numbers.size else b""


def unpacked(raw: bytes, n: int, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=width * n, codec="zstd", asbytes=True) if n else b"", np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def hashed_chunks(column: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word hashes of some bytes of texts, and the words of each text (a text is never cut)."""
    some, size = [], 0
    for texts in wordhash.slices(column):
        words, bounds = wordhash.hashes(texts)
        some.append((words, np.diff(bounds)))
        size += sum(map(len, texts))
        if size >= limit:
            yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
            some, size = [], 0
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def code(docs: DataFrame, head: Head, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Written chunks of texts: chunk, ident, held_out and sizes (tokens) of each text, symbols (``packed``,
    all texts in a row: ranks, ``head.symbols`` is "other", one more the end, then places in words),
    words (int64: the chunk's words beyond the ranks), counts (``packed``, of these; none yet)."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, task = shared.value, TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 33
        for batch in batches:
            at = 0
            for hashed, sizes in hashed_chunks(batch.column(2), CHUNK):
                place = head.find(hashed)
                symbol = np.where(place >= 0, head.rank[place] if len(head.rank) else 2**40, 2**40)
                del place
                far = symbol >= head.symbols
                words, index = np.unique(hashed[far], return_inverse=True)
                symbol[far] = index + head.symbols + 2
                symbol = np.insert(symbol, np.cumsum(sizes), head.symbols + 1)
                n = len(sizes)
                lists = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(sizes + 1, pa.int64())]
                columns = [
                    pa.array([chunk]), *[pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in lists],
                    pa.array([packed(symbol)]), pa.array([words.tobytes()]), pa.array([b""]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                chunk += 1
                at += n

    kind = docs.schema[ident].dataType.simpleString()
    schema = f"chunk bigint, ident array<{kind}>, held_out array<boolean>, sizes array<bigint>, symbols binary, words binary, counts binary"
    names = [f.split()[0] for f in schema.split(", ")]
    return materialize(docs.select(ident, held_out(F.col(ident)).alias("held_out"), text).mapInArrow(run, schema))


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The words' buckets (``bucket_column`` says the same in Spark)."""
    return (words.view(np.uint64) >> np.uint64(40)).astype(np.int64) % buckets


def bucket_column(word: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(word, 40) % buckets


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets ascending and the places of their words."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for part in np.split(order, cuts[1:]) if len(order) else []:
        yield int(bucket[part[0]]), part


def sweep(spark: SparkSession) -> None:
    """Shuffle files go with the driver's garbage: first Python's, which may hold plans, then the JVM's.
    Python hands over what it dropped within a second, so call this a job later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def buckets_for(coded: DataFrame) -> int:
    spark = coded.sparkSession
    words = (coded.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 8
    spread = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), words // SPREAD_WORDS)
    return max(1, -(-words // BUCKET_WORDS), spread)


def gathered(coded: DataFrame, replies: DataFrame) -> DataFrame:
    """coded with ``got``: the values of its words by bucket (null if it has none)."""
    got = replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "values"))).alias("got"))
    return coded.join(got.select("chunk", F.transform("got", lambda x: x["values"]).alias("got")), "chunk", "left")


def in_place(got: list[bytes] | None, bucket: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers for each word, from those by bucket."""
    out = np.zeros((len(bucket), width), np.int64)
    for raw, (_, part) in zip(got or [], dealt(bucket), strict=True):
        out[part] = unpacked(raw, len(part) * width, "<i8").reshape(-1, width)
    return out


def counted(coded: DataFrame, vocab: DataFrame, buckets: int) -> DataFrame:
    """coded, written again with the counts of its words. Their hashes give way to ``links`` (``packed``): bucket
    and place among the bucket's words that need sums; bucket ``buckets`` for words that need none: of one
    chunk alone, or of no training text."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, np.int64)
                some = [(b, words[part].tobytes()) for b, part in dealt(bucket_of(words, buckets))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array([b for b, _ in some], pa.int64()), pa.array([w for _, w in some], pa.binary())], ["chunk", "bucket", "words"])

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        word, c = known.column("word").to_numpy(), known.column("c").to_numpy()
        order = np.argsort(word)
        word, c = np.append(word[order], 0), np.append(c[order], 0)  # the last one: not found
        lists = [np.frombuffer(raw, np.int64) for raw in asked.column("words").to_pylist()]
        words, index, chunks = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        at = np.searchsorted(word[:-1], words)
        found = np.where((word[at] == words) & (at < len(word) - 1), c[at], 0)
        summed = (chunks > 1) & (found > 0)
        rows = np.stack([found, np.where(summed, np.cumsum(summed) - 1, -1)], 1)[index]
        values = [packed(part, "<i8") for part in np.split(rows, np.cumsum([len(x) for x in lists])[:-1])] if lists else []
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(values, pa.binary())], ["chunk", "bucket", "values"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                bucket = bucket_of(np.frombuffer(row.column(5)[0].as_py(), np.int64), buckets)
                count, place = in_place(row.column(7)[0].as_py(), bucket, 2).T
                links = np.where(place < 0, buckets << 32, (bucket << 32) + place)
                yield pa.RecordBatch.from_arrays([*row.columns[:5], *[pa.array([packed(x, "<i8")]) for x in (links, count)]], names)

    asked = coded.select("chunk", "words").mapInArrow(ask, "chunk bigint, bucket bigint, words binary")
    known = vocab.select(bucket_column(F.col("word"), buckets).alias("bucket"), "word", "c")
    replies = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "chunk bigint, bucket bigint, values binary")
    schema = coded.withColumnRenamed("words", "links").schema
    names = schema.names
    return materialize(gathered(coded, replies).mapInArrow(fill, schema))


@dataclass
class Model:
    """start[0]: of texts, start[1]: of later segments; emit[symbol, state], with a last row of ones for
    padding. Other words: (expected count + share) / whole, or before the first round (count + 1) of
    ``others`` of what "other" has."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    share: np.ndarray | None = None
    whole: np.ndarray | None = None
    others: float = 1.0

    def with_words(self, counts: np.ndarray, expected: np.ndarray | None) -> Model:
        """The same with the rows of a chunk's words before the padding."""
        emit = self.emit.copy()
        if self.share is None:
            words = emit[-3] * (counts[:, None] + 1) / self.others
            emit[-3] /= self.others
        else:
            words = (expected + self.share) / self.whole
        return Model(self.start, self.move, np.vstack([emit[:-1], words, emit[-1:]]))

    @staticmethod
    def first(counts: np.ndarray, states: int, seed: int = 7) -> Model:
        """Word frequencies, tilted at random for each state; states rarely change."""
        rng = np.random.default_rng(seed)
        emit = (counts[:, None] + 0.5) * np.exp(rng.normal(0, 0.7, (len(counts), states)))
        move = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
        return Model(np.full((2, states), 1 / states), move, np.vstack([emit / emit.sum(0), np.ones(states)]))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, rest: np.ndarray, shares: int) -> Model:
        """rest: expected counts of all other words; shares: words that get one more, unknown ones as one."""
        scaled = lambda x, axis: x / x.sum(axis, keepdims=True)
        states = np.maximum(emit.sum(0) + rest, 1e-9)
        share = states / states.sum()
        whole = states + shares * share
        return Model(scaled(start + 0.1, 1), scaled(move + 0.1, 1), np.vstack([(emit + share) / whole, np.ones(len(rest))]), share, whole)


def summed_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums (n rows) of the rows of ``values`` by their places."""
    width = values.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), values.ravel(), n * width).reshape(n, width)


def expected(model: Model, segments: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of segments (rows, padded at the end with the number of
    symbols), and their log-likelihood."""
    n, length = segments.shape
    pad, states = len(model.emit) - 1, model.move.shape[0]
    emit = model.emit.astype(np.float32)
    move = model.move.astype(np.float32)
    seen = np.ascontiguousarray(segments.T, np.intp)
    b = emit[seen]
    alpha, scale = np.empty((length, n, states), np.float32), np.empty((length, n), np.float32)
    alpha[0] = model.start.astype(np.float32)[np.where(first, 0, 1)]
    ones = np.ones(states, np.float32)
    for t in range(length):
        if t:
            np.matmul(alpha[t - 1], move, out=alpha[t])
        alpha[t] *= b[t]
        np.matmul(alpha[t], ones, out=scale[t])
        each = scale[t][:, None]
        alpha[t] /= each
        b[t] /= each
    beta = np.ones((n, states), np.float32)
    moves = np.zeros((states, states))
    gamma = alpha  # overwritten from the end
    for t in range(length - 1, 0, -1):
        ahead = b[t] * beta
        live = (seen[t] != pad)[:, None]
        moves += alpha[t - 1].T @ (ahead * live)
        gamma[t] *= beta
        beta = ahead @ move.T
    gamma[0] *= beta
    moves *= model.move
    starts = np.array([gamma[0][first].sum(0), gamma[0][~first].sum(0)], float)
    emits = summed_by(seen.ravel(), gamma.reshape(-1, states), pad + 1)[:pad]
    return starts, moves, emits, float(np.log(scale[seen != pad]).sum())


def cut(texts: list[np.ndarray], pad: int, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Segments of all texts, and which are the first of their text."""
    counts = np.array([-(-len(t) // length) for t in texts])
    out = np.full((int(counts.sum()), length), pad, np.int32)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for k, t in zip(at, texts, strict=True):
        out[k : k + -(-len(t) // length)].ravel()[: len(t)] = t
    first = np.zeros(len(out), bool)
    first[at] = True
    return out, first


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One chunk at a time."""
    return (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(len(batch)))


def train(coded: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """``fit`` where ``counts`` has all words."""
    return fit(coded, counts, states, rounds)[:2]


def fit(
    coded: DataFrame, counts: np.ndarray, states: int = STATES, rounds: int = ROUNDS, n_words: int | None = None, buckets: int = 1, gain: float = GAIN
) -> tuple[Model, list[float], DataFrame | None]:
    """Baum-Welch over the texts that are not held out; counts: of each symbol, "other" for all words
    beyond; n_words: different training tokens. Also the log-likelihood of each round, and the last
    expected counts of the chunks' words."""
    spark = coded.sparkSession
    n = len(counts)
    n_words = n - 1 if n_words is None else n_words
    model, likelihoods, replies, before = Model.first(counts, states), [], None, None
    model.others = float(counts[-2] + n_words - (n - 2) - (counts[-1] > 0) + 1)
    shares = n_words + 1 + int(counts[-1] == 0)
    texts = coded.select("chunk", "held_out", "sizes", "symbols", *[c for c in coded.columns if c in ("links", "counts")])
    schema = "chunk bigint, bucket bigint, n bigint, places binary, values binary"
    names = ["chunk", "bucket", "n", "places", "values"]
    for _ in range(rounds if counts.sum() else 0):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            # rows: symbols, then two for starts, one for each state's moves, one for the other words, one for the likelihood
            total = np.zeros((n + 4 + states, states))
            for row in rows_of(batches):
                symbols, sizes = unpacked(row["symbols"], sum(row["sizes"])), row["sizes"]
                bucket, place, _, local = local_model(model, row, symbols, buckets)
                mine = np.zeros((len(bucket), states))
                training = [t for t, held in zip(np.split(symbols, np.cumsum(sizes)[:-1]), row["held_out"], strict=True) if not held]
                segments, first = cut(training, n + len(bucket)) if training else (np.zeros((0, SEGMENT), np.int32), np.zeros(0, bool))
                for k in range(0, len(segments), BATCH_SEGMENTS):
                    starts, moves, emits, likelihood = expected(local, segments[k : k + BATCH_SEGMENTS], first[k : k + BATCH_SEGMENTS])
                    total[:n] += emits[:n]
                    mine += emits[n:]
                    total[n : n + 2] += starts
                    total[n + 2 : n + 2 + states] += moves
                    total[-1, 0] += likelihood
                del symbols, training, segments, local
                whole = np.rint(mine * UNIT).astype(np.int64)
                total[-2] += whole.sum(0) / UNIT  # of what moves, so that the emissions sum to one
                for b, part in dealt(bucket):
                    places = packed(np.diff(place[part], prepend=0), "<i8") if b < buckets else b""
                    columns = [pa.array([x], pa.int64()) for x in (row["chunk"], b, len(part))] + [pa.array([x], pa.binary()) for x in (places, packed(whole[part], "<i8"))]
                    yield pa.RecordBatch.from_arrays(columns, names)
            stripes = range(0, len(total), STRIPE)
            columns = [pa.nulls(len(stripes), pa.int64()), pa.array([-1 - k for k in range(len(stripes))], pa.int64()), pa.nulls(len(stripes), pa.int64()), pa.nulls(len(stripes), pa.binary()), pa.array([total[k : k + STRIPE].tobytes() for k in stripes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

        def add(stripe: pa.Table) -> pa.Table:
            values = sum(np.frombuffer(raw, np.float64) for raw in stripe.column("values").to_pylist())
            return pa.table([stripe.column("bucket").slice(0, 1), pa.array([values.tobytes()])], ["bucket", "values"])

        def merge(bucket: pa.Table) -> pa.Table:
            sizes = bucket.column("n").to_pylist()
            at = np.concatenate([np.cumsum(unpacked(raw, k, "<i8")) for raw, k in zip(bucket.column("places").to_pylist(), sizes, strict=True)])
            values = np.concatenate([unpacked(raw, k * states, "<i8") for raw, k in zip(bucket.column("values").to_pylist(), sizes, strict=True)])
            summed = summed_by(at, values.reshape(-1, states), int(at.max()) + 1).astype(np.int64)  # whole numbers below 2**53: exact
            parts = np.split(at, np.cumsum(sizes)[:-1])
            return pa.table([bucket.column("chunk"), bucket.column("bucket"), pa.array([packed(summed[x], "<i8") for x in parts])], ["chunk", "bucket", "values"])

        source = gathered(texts, replies) if replies is not None else texts.withColumn("got", F.lit(None).cast("array<binary>"))
        made = materialize(source.mapInArrow(run, schema))
        if before is not None:
            release(before)
        before = made
        del source
        parts = dict(made.where("bucket < 0").groupBy("bucket").applyInArrow(add, "bucket bigint, values binary").collect())
        total = np.frombuffer(b"".join(bytes(parts[k]) for k in sorted(parts, reverse=True)), np.float64).reshape(-1, states)
        merged = made.where(f"bucket >= 0 AND bucket < {buckets}").groupBy("bucket").applyInArrow(merge, "chunk bigint, bucket bigint, values binary")
        replies = merged.union(made.where(f"bucket = {buckets}").select("chunk", "bucket", "values"))
        sweep(spark)  # of the round's shuffles
        likelihoods.append(float(total[-1, 0]))
        model = Model.of_counts(total[n : n + 2], total[n + 2 : n + 2 + states], total[:n], total[-2], shares)
        shared.destroy()
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < gain * abs(likelihoods[-1]):
            break
    return model, likelihoods, replies


def local_model(model: Model, row: dict, symbols: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Model]:
    """Buckets, places and counts of a chunk's words, and the model with them."""
    k = max(0, int(symbols.max(initial=0)) + 2 - len(model.emit))  # each of them stands in the chunk
    links = unpacked(row["links"], k, "<i8") if row.get("links") else np.full(k, buckets << 32)
    counts = unpacked(row["counts"], k, "<i8") if row.get("counts") else np.zeros(k, np.int64)
    bucket, place = links >> 32, links & (2**32 - 1)
    got = None if model.share is None else in_place(row["got"], bucket, len(model.move)) / UNIT
    return bucket, place, counts, model.with_words(counts, got)


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each whole text's probability by the scaled forward recursion; longest texts first, so those still running are a prefix."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order])
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = np.zeros(len(order))
    a = np.zeros((0, 0))
    for t in range(int(sizes[0])):
        running = int(np.searchsorted(-sizes, -t, "left"))  # sizes > t
        b = model.emit[flat[begins[:running] + t]]
        a = model.start[0] * b if t == 0 else (a[:running] @ model.move) * b
        scale = a.sum(1)
        a /= scale[:, None]
        total[:running] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = total
    return out


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, head_size: int = HEAD, symbols: int = SYMBOLS) -> DataFrame:
    """ident, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    vocab = vocabulary(docs.where(~held_out(F.col(ident))), text)
    n_train, n_words = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = (vocab.where(F.col("word") == int(END)).select("c").first() or [0])[0]
    head, _ = head_of(vocab, head_size, symbols)
    emitted = head.rank < head.symbols
    counts = np.zeros(head.symbols + 2)
    counts[head.rank[emitted]] = head.count[emitted]
    counts[-1] = ends
    counts[-2] = n_train - counts.sum()
    plain = code(docs, head, ident, text)
    buckets = buckets_for(plain)
    sweep(spark)
    coded = counted(plain, vocab, buckets)
    release(plain, vocab)
    model, _, replies = fit(coded, counts, states, rounds, n_words, buckets)
    shared = spark.sparkContext.broadcast((model, np.append(counts[:-2], [0, ends])))
    base_share = float(np.log10(n_train + 1 * (n_words + 1)))
    names = ["ident", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value
        for row, texts in ((row, batch.slice(k, 1)) for batch in batches for k in range(len(batch)) for row in rows_of([batch.slice(k, 1)])):
            symbols, sizes = unpacked(row["symbols"], sum(row["sizes"])), np.array(row["sizes"])
            _, _, found, local = local_model(model, row, symbols, buckets)
            count = np.append(counts, found)
            begins = np.cumsum(sizes) - sizes  # every text has its end, so none is empty
            base = np.add.reduceat(np.log10(count + 1.0)[symbols] - base_share, begins)
            known = np.add.reduceat((count > 0)[symbols].astype(np.int64), begins)
            made = log_likelihoods(local, np.split(symbols, begins[1:]))
            yield pa.RecordBatch.from_arrays([texts.column(0).flatten(), texts.column(1).flatten(), pa.array(sizes), pa.array(known), pa.array(base), pa.array(made)], names)

    columns = ["ident", "held_out", "sizes", "symbols", "links", "counts"]
    source = gathered(coded.select("chunk", *columns), replies) if replies is not None else coded.withColumn("got", F.lit(None).cast("array<binary>"))
    kind = docs.schema[ident].dataType.simpleString()
    scored = source.select(*columns, "got").mapInArrow(run, f"ident {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("ident").alias(ident), "held_out", "n_tokens", "n_known", F.lit(int(n_train)).cast("bigint").alias("train_tokens"), "base_score", "score")
