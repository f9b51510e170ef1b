"""Line dedup over the whole corpus, in DataFrame operations only.

A line is dropped if an earlier line, in the order of (doc_id, line number), has the same words or,
for lines of at least ``NEAR_WORDS`` words, words one edit away (one word inserted, deleted or
replaced). Words are compared lower-cased. Lines of fewer than ``MIN_WORDS`` words stay.

Near lines are found by the deletion neighbourhood: every line emits itself and all its variants
with one word deleted, as hashed keys. Lines that share a variant deleted at the same place differ
by a replacement, a line that equals another's variant by an insertion. Each group keeps its
earliest line and every other member is linked to it, so groups never become pairs; links are then
verified on the words.

Most lines have no near line. Two lines one edit apart share their first or their last half, so
first each line emits the hashes of its halves (up to four); only lines that share a half with a
different line go on. This loses nothing.

A very long line costs its words once: variants are hashed from running values.

Equal keys are counted, or reduced to their minimum, before they are shuffled. Lines are joined with
the fate of repeated lines only; a side is broadcast only after its rows were counted.

Defined results: null and empty texts have no lines to drop and stay as they are; rows with the same
doc_id count as one document (equal lines at the same number all stay); null doc_id comes first in
the order; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from closura.llm.decontaminate import BROADCAST_ROWS, checked
from closura.session import materialize, release

WORD = "[^\\x20\\x09-\\x0D]+"
MIN_WORDS = 5
NEAR_WORDS = 8


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))


def _key(ident: str, text: str) -> Column:
    return F.xxhash64(ident, text)


def _lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """doc, key, line, words and n of every line that can be dropped; h and h2 identify the words."""
    rows = docs.select(F.col(ident).alias("doc"), _key(ident, text).alias("key"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    rows = rows.select("doc", "key", "line", _words(F.col("raw")).alias("words")).withColumn("n", F.size("words")).where(F.col("n") >= MIN_WORDS)
    # each word is hashed once; all else is made of these numbers
    return rows.withColumn("marks", F.transform("words", lambda w: F.xxhash64(w))).withColumns({"h": F.xxhash64("marks"), "h2": F.hash("marks")})


def _halves() -> Column:
    """Hashes of the first and last n/2 and (n-1)/2 words: lines of n and n+1 words have one length in common."""
    out = []
    for m in (F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")):
        out.append(F.xxhash64(F.lit("first"), m, F.slice("marks", F.lit(1), m)))
        out.append(F.xxhash64(F.lit("last"), m, F.slice("marks", F.col("n") - m + 1, m)))
    return F.array_distinct(F.array(*out))


def _without(words: str, i: Column) -> Column:
    """The words but the one at i (from 0); all of them for -1."""
    n = F.size(words)
    less = F.concat(F.slice(words, F.lit(1), i), F.slice(words, i + 2, F.greatest(n - i - 1, F.lit(0))))
    return F.when(i < 0, F.col(words)).otherwise(less)


def _variants(suspects: DataFrame) -> DataFrame:
    """h, first, i, variant, m: a hash of the words of each line without the one at i (from 0; -1: of all) and their number.

    A hash is the exclusive or of its words' hashes with their places. The words before a deleted one keep their places, those
    after it move up by one, so running values of both kinds give every variant in constant time, however long the line."""
    per = Window.partitionBy("h").orderBy("i")
    upto = per.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = suspects.select("h", "n", "first", F.posexplode("words").alias("i", "word"))
    df = df.select("h", "n", "first", "i", F.xxhash64("word", "i").alias("stays"), F.xxhash64("word", F.col("i") - 1).alias("moves"))
    df = df.withColumns({"before": F.bit_xor("stays").over(upto), "moved": F.bit_xor("moves").over(upto), "all": F.bit_xor("moves").over(Window.partitionBy("h"))})
    cut = F.col("before").bitwiseXOR(F.col("stays")).bitwiseXOR(F.col("moved")).bitwiseXOR(F.col("all"))
    cut = F.struct(F.col("i").alias("i"), cut.alias("variant"), (F.col("n") - 1).alias("m"))
    whole = F.struct(F.lit(-1).alias("i"), F.col("before").alias("variant"), F.col("n").alias("m"))
    both = F.when(F.col("i") == F.col("n") - 1, F.array(cut, whole)).otherwise(F.array(cut))
    return df.select("h", "first", F.explode(both).alias("v")).select("h", "first", "v.*")


def near_links(suspects: DataFrame) -> DataFrame:
    """suspects: h, n, words, first (order of the line's first occurrence), one row per line.
    Returns h and ``earlier``: for lines with an earlier line one edit away, the h of one such."""
    variants = materialize(_variants(suspects))
    own = F.struct("first", "h", "i").alias("own")
    earliest = lambda when: F.min(F.when(when, F.struct("first", "h", "i")))
    # replacements: same variant, same place; insertions: a whole line (i = -1) against variants
    replaced = variants.where("i >= 0").groupBy("variant", "m", "i").agg(earliest(F.lit(True)).alias("best"), F.count(F.lit(1)).alias("members")).where("members > 1")
    replaced = variants.select("variant", "m", "i", own).join(checked(materialize(replaced.drop("members"))), ["variant", "m", "i"])
    sides = variants.groupBy("variant", "m").agg(earliest(F.col("i") < 0).alias("whole"), earliest(F.col("i") >= 0).alias("cut"))
    sides = materialize(sides.where("whole IS NOT NULL AND cut IS NOT NULL"))
    inserted = variants.select("variant", "m", own).join(checked(sides), ["variant", "m"])
    inserted = inserted.withColumn("best", F.when(F.col("own.i") < 0, F.col("cut")).otherwise(F.col("whole")))
    links = replaced.select("own", "best").union(inserted.select("own", "best"))
    links = links.where(F.struct("best.first", "best.h") < F.struct("own.first", "own.h"))
    links = links.select(F.col("own.h").alias("h"), F.col("own.i").alias("i"), F.col("best.h").alias("earlier"), F.col("best.i").alias("j")).distinct()
    links = materialize(links)
    # verify on the words
    texts = suspects.select("h", "words").join(checked(links.select("h").union(links.select("earlier")).distinct()), "h", "left_semi")
    texts = materialize(texts)
    pairs = links.join(texts, "h").join(texts.select(F.col("h").alias("earlier"), F.col("words").alias("others")), "earlier")
    same = _without("words", F.col("i")) == _without("others", F.col("j"))
    one_edit = (F.col("i") == F.col("j")) | (F.col("i") < 0) | (F.col("j") < 0)
    out = materialize(pairs.where(same & one_edit).groupBy("h").agg(F.min("earlier").alias("earlier")))
    release(variants, sides, links, texts)
    return out


def dropped(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Written rows (key of the document, line number from 0, near) of all lines to drop."""
    lines = _lines(docs, ident, text)
    slim = materialize(lines.select("doc", "key", "line", "h", "h2", "n", F.when(F.col("n") >= NEAR_WORDS, _halves()).alias("halves")))
    seen = slim.groupBy("h", "h2", "n").agg(F.min(F.struct("doc", "line", "key")).alias("at"), F.count(F.lit(1)).alias("copies"))
    seen = materialize(seen.select("h", "h2", "n", F.struct("at.doc", "at.line").alias("first"), F.col("at.key").alias("key"), "copies"))

    halves = slim.where("halves IS NOT NULL").select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    near = materialize(halves.join(checked(materialize(shared)), "half", "left_semi").select("h").distinct())
    wanted = materialize(seen.join(checked(near), "h", "left_semi"))
    from_docs = docs.join(checked(wanted.select(F.col("key").alias("__key")).distinct()), _key(ident, text) == F.col("__key"), "left_semi")
    texts = _lines(from_docs, ident, text).select("h", "key", "words")
    suspects = texts.join(checked(wanted.select("h", "key", "n", "first")), ["h", "key"]).dropDuplicates(["h"])
    suspects = materialize(suspects.select("h", "n", "words", "first"))
    links = near_links(suspects)

    fate = seen.join(links.select("h", F.lit(True).alias("near")), "h", "left").where("copies > 1 OR near")
    fate = materialize(fate.select("h", "h2", "n", "first", F.coalesce("near", F.lit(False)).alias("near")))
    hits = slim.select("doc", "key", "line", "h", "h2", "n").join(checked(fate), ["h", "h2", "n"])
    out = materialize(hits.where(F.col("near") | (F.col("first") < F.struct("doc", "line"))).select("key", "line", "near").distinct())
    release(slim, seen, shared, near, wanted, suspects, links, fate)
    return out


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """All rows and columns with the kept lines as ``text``; with ``counts`` also n_lines, n_dropped
    (both kinds) and n_near."""
    gone = dropped(docs, ident, text)
    per = gone.groupBy(F.col("key").alias("__key")).agg(F.collect_list("line").alias("__gone"), F.sum(F.col("near").cast("bigint")).alias("__near"))
    joined = docs.join(checked(materialize(per), 4 * BROADCAST_ROWS, of=gone), _key(ident, text) == F.col("__key"), "left").withColumn("__lines", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n")
    none = F.lit(0).cast("bigint")
    more = [
        F.coalesce(F.size("__lines").cast("bigint"), none).alias("n_lines"),
        F.coalesce(F.size("__gone").cast("bigint"), none).alias("n_dropped"),
        F.coalesce("__near", none).alias("n_near"),
    ]
    new_text = F.when(F.col("__gone").isNull(), joined[text]).otherwise(kept).alias(text)
    return joined.select(*[new_text if c == text else joined[c] for c in docs.columns], *(more if counts else []))
