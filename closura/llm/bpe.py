"""Byte-level BPE encoding and decoding over Arrow batches.

``ByteBPE`` builds a ``tokenizers`` model from a rank file (base64 token, rank). Byte-level models
name each byte by a printable character; that table maps text bytes to the model's alphabet and,
reversed, ids back to bytes. Every way to split a token into two ranked parts becomes a merge with
the token's rank, and a whole match that is itself a token is taken as such, so ids equal those of
the rank file's own library.

A text is cut into the matches of the splitting pattern, which the model encodes one by one; they repeat, so each
task keeps recent ones, with what a caller wants of their ids, in a cache of fixed size. The cache only
saves work: it never decides a result. Texts of characters below U+0250, whose classes are the same in every
edition of Unicode, are cut by Python's ``regex``, others by the library's own, slower splitter.

Null text encodes as empty text: no ids. Ids of rows and other columns are left as they are;
repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import itertools
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_MATCHES = 150_000  # per generation; two are kept
SLICE_CHARS = 1_000_000  # texts are taken together up to this length

# Characters with the Unicode property White_Space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
STEADY = "\u0250"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 bytes stand for themselves, the others are numbered from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of a batch, null as empty, without holding all of them as Python objects."""
    for at in range(0, len(column), rows):
        yield from (text or "" for text in column.slice(at, rows).to_pylist())


def matches_of(texts: Iterable[str | None], cut: Callable[[str], list[str]]) -> Iterator[list[list[str]]]:
    """The matches of each text, a few texts at a time."""
    some, size = [], 0
    for text in texts:
        some.append(cut(text or ""))
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


class RecentMatches:
    """A dictionary from match to what was made of it that forgets what was not asked for of late."""

    def __init__(self, limit: int = CACHE_MATCHES):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        """Workers outlive tasks; a task leaves nothing behind."""
        self.new, self.old = {}, {}

    def of(self, wanted: set[str], encode) -> dict:
        found = {c: self.new[c] for c in wanted & self.new.keys()}
        wanted -= found.keys()
        found.update((c, self.old[c]) for c in wanted & self.old.keys())
        wanted -= found.keys()
        missing = list(wanted)
        found.update(zip(missing, encode(missing), strict=True))
        if len(self.new) + len(found) > self.limit:
            self.old, self.new = self.new, {}
        self.new.update(itertools.islice(found.items(), self.limit))
        return found


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        char_of = byte_alphabet()
        spell = lambda token: "".join(char_of[b] for b in token)
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = ((token[:i], token[i:]) for i in range(1, len(token)))
            pairs = [(a, b) for a, b in cuts if a in ranks and b in ranks]
            pairs.sort(key=lambda pair: (ranks[pair[0]], ranks[pair[1]]))
            merges += [(spell(a), spell(b)) for a, b in pairs]
        self.ranks = ranks
        self.model = Tokenizer(
            models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        )
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        byte_of = {c: b for b, c in enumerate(char_of)}
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for spelled, rank in self.model.get_vocab().items():
            self.bytes_of[rank] = bytes(byte_of[c] for c in spelled)
        self.decimal_of = [str(i) for i in range(len(self.bytes_of))]
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.char_of = dict(enumerate(char_of))
        # \s is White_Space, without the separators that Python counts as such
        self.matches = regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")).findall
        self.recent = RecentMatches()

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern, which make up the text."""
        if text.isascii() or max(text) < STEADY:
            return self.matches(text)
        return [match for match, _ in self.splitter.pre_tokenize_str(text)]

    def _ids(self, matches: list[str]) -> Iterator[list[int]]:
        tokens, char_of = self.model.model.tokenize, self.char_of
        for match in matches:
            yield [t.id for t in tokens(match.encode().decode("latin-1").translate(char_of))]

    def _encode_matches(self, matches: list[str]) -> Iterator[bytes]:
        return (array("I", ids).tobytes() for ids in self._ids(matches))

    def _digest_pieces(self, matches: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Of each match the number of ids, the ids in decimals (each before a comma) and their bytes."""
        decimal_of = self.decimal_of
        for ids in self._ids(matches):
            yield len(ids), ",".join([decimal_of[i] for i in ids]) + ",", self.decode_bytes(ids)

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for some in matches_of(texts, self.cut):
            found = self.recent.of(set(itertools.chain.from_iterable(some)), self._encode_matches)
            for matches in some:
                yield np.frombuffer(b"".join([found[c] for c in matches]), np.uint32)

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids and the SHA-256 digests of its ids in decimals and of their bytes."""
        for some in matches_of(texts, self.cut):
            found = self.recent.of(set(itertools.chain.from_iterable(some)), self._digest_pieces)
            for matches in some:
                n, ids, decoded = zip(*[found[c] for c in matches], strict=True) if matches else ((), (), ())
                yield sum(n), hashlib.sha256("".join(ids)[:-1].encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()

    def decimal(self, ids: Iterable[int]) -> str:
        return ",".join([self.decimal_of[i] for i in ids])

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as ids arrive: bytes of a character split over ids wait for the rest; what can
        never become a character turns into U+FFFD."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := decoder.decode(self.bytes_of[i]):
                yield piece
        if rest := decoder.decode(b"", final=True):
            yield rest

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per id the first character it touches and the one after the last; ids that share a
        split character overlap in it."""
        data = np.frombuffer(text.encode(), np.uint8)
        char_at = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return char_at[starts], (char_at[ends - 1] + 1 if len(ends) else ends)


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """One model for each Python worker."""
    return ByteBPE(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``ident``, ``ids`` and, on demand, ``starts`` and ``ends`` (character offsets) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = list(bpe.encode(texts))
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                spans = [bpe.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                columns += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.recent.clear()

    names = ["ident", "ids"] + ["starts", "ends"] * offsets
    kind = docs.schema[ident].dataType.simpleString()
    schema = f"ident {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return docs.select(ident, text).mapInArrow(run, schema).withColumnRenamed("ident", ident)


def decode(encoded: DataFrame, path: str, pattern: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``ident``, ``decoded`` (bytes) and ``text`` of every list of ids; null gives empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(map(bpe.decode_bytes, lists), pa.binary())]
            columns.append(pa.array(["".join(bpe.decode_stream(x)) for x in lists], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["ident", "decoded", "text"])

    kind = encoded.schema[ident].dataType.simpleString()
    return encoded.select(ident, ids).mapInArrow(run, f"ident {kind}, decoded binary, text string").withColumnRenamed("ident", ident)


def round_trip(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return counts and digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            counts, digests, decoded = zip(*bpe.digests(texts_of(batch.column(1))), strict=True) if batch.num_rows else ((), (), ())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["ident", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.recent.clear()

    kind = docs.schema[ident].dataType.simpleString()
    schema = f"ident {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(ident, text).mapInArrow(run, schema).withColumnRenamed("ident", ident)
