"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``build_index`` stores the postings (term, document, position) of the training texts, each task's
output ordered by term: one scan, no shuffle. Terms are 64-bit hashes of words. Only terms that the
search can ask for are stored if ``vocabulary`` is given; the end of every text is a posting of the
empty term, at the number of words.

``phrase_matches`` looks for windows of 13 words. For each window it reads the two rarest terms'
lists (by counts in the index), shifts every posting by the term's offset in the benchmark item to
an alignment (position of the item's first word in the document), and intersects the lists by
grouping on (item, document, alignment). The few alignments left probe the other words' lists.
Windows whose every word is there are matches. ``proximity_matches`` finds places where all terms
lie close to one of the rarest.

Documents are keyed by a hash of id and text: repeated rows share their postings and each gets a
result. Sides are broadcast only after their rows were counted (``BROADCAST_ROWS``); larger ones
are joined by shuffle.

Defined results: null and empty texts have no words and are never contaminated; an item without
words has no window; items with equal text each count; a null item_id is listed as ``null``; null
doc_id stays null; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from closura.session import materialize

# Fixed values of the contamination rule.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = 13
PERCENT_INVERSE = 20  # 20 * n_hit >= n_words

BROADCAST_ROWS = 500_000  # two or three longs each
END = ""  # the term that ends each text


def words(text: Column) -> Column:
    """Words with A-Z lower-cased; lower() would touch other letters, so only ASCII texts take it."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.regexp_extract_all(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def term(word: Column | str) -> Column:
    return F.xxhash64(word)


def checked(df: DataFrame, rows: int = BROADCAST_ROWS, *, of: DataFrame | None = None) -> DataFrame:
    """Marked for broadcast if it, or what its arrays were gathered ``of``, has at most so many rows."""
    counted = df if of is None else of
    return F.broadcast(df) if counted.limit(rows + 1).count() <= rows else df


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Written postings: term, key, pos; the end of each text also has ``ident``."""
    rows = docs.select(F.col(ident).alias("ident"), F.xxhash64(ident, text).alias("key"), F.concat(words(F.col(text)), F.array(F.lit(END))).alias("w"))
    postings = rows.select("ident", "key", F.posexplode("w").alias("pos", "word")).select("ident", "key", "pos", term("word").alias("term"))
    if vocabulary is not None:
        wanted = materialize(vocabulary.select("term").union(docs.sparkSession.range(1).select(term(F.lit(END)).alias("term"))).distinct())
        postings = postings.join(checked(wanted), "term")
    is_end = F.col("term") == term(F.lit(END))
    return materialize(postings.select("term", "key", "pos", F.when(is_end, F.col("ident")).alias(ident)).sortWithinPartitions("term", "key", "pos"))


def item_words(benchmark: DataFrame, ident: str = "item_id", text: str = "text") -> DataFrame:
    """One row per word of every item: item, q, term, n_item."""
    rows = benchmark.select(F.xxhash64(ident, text).alias("item"), words(F.col(text)).alias("w")).dropDuplicates(["item"])
    return rows.select("item", F.size("w").alias("n_item"), F.posexplode("w").alias("q", "word")).select("item", "q", term("word").alias("term"), "n_item")


def _span(size: Column, span: int) -> Column:
    return F.least(size, F.lit(span))


def phrase_matches(index: DataFrame, asked: DataFrame, span: int = SPAN) -> DataFrame:
    """Windows of ``asked`` (as from ``item_words``) in the index: item, key, and the array
    ``at`` of document positions covered by the item's windows at one alignment."""
    counts = materialize(index.join(checked(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_postings")))
    # a window whose words are not all in the index cannot occur; its missing words make the inner join short
    windows = asked.select("item", "n_item", "q", "term").join(counts, "term", "left").withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    first = F.greatest(F.col("q") - span + 1, F.lit(0))
    last = F.least(F.col("q"), F.greatest(F.col("n_item") - span, F.lit(0)))
    per = Window.partitionBy("item", "s").orderBy("n_postings", "q")
    ranked = windows.withColumn("s", F.explode(F.sequence(first, last))).withColumn("r", F.row_number().over(per))
    windows = ranked.groupBy("item", "s", "n_item").agg(
        F.collect_list(F.when(F.col("r") <= 2, F.col("q"))).alias("rarest"), F.min("n_postings").alias("least")
    )
    windows = materialize(windows.where("least > 0"))
    anchors = materialize(windows.select("item", F.explode("rarest").alias("q")).distinct().join(asked, ["item", "q"]).select("term", "item", "q"))

    found = index.select("term", "key", "pos").join(checked(anchors), "term").select("item", "key", "q", (F.col("pos") - F.col("q")).alias("start"))
    found = found.groupBy("item", "key", "start").agg(F.collect_set("q").alias("have"))
    per_item = windows.groupBy("item", "n_item").agg(F.collect_list(F.struct("s", "rarest")).alias("windows"))
    open_ = found.join(checked(per_item, of=windows), "item")
    open_ = open_.withColumn("s", F.expr("transform(filter(windows, w -> size(array_except(w.rarest, have)) = 0), w -> w.s)")).where(F.size("s") > 0)
    open_ = materialize(open_.withColumn("size", _span(F.col("n_item"), span)).drop("windows", "n_item"))

    asked_at = F.expr("array_except(array_distinct(flatten(transform(s, x -> sequence(x, x + size - 1)))), have)")
    probes = open_.select("item", "key", "start", F.explode(asked_at).alias("q")).join(checked(asked.select("item", "q", "term")), ["item", "q"])
    probes = probes.withColumn("pos", F.col("start") + F.col("q"))
    there = index.select("term", "key", "pos").join(checked(open_.select("key").distinct()), "key", "left_semi")
    more = probes.join(there, ["key", "pos", "term"], "left_semi").groupBy("item", "key", "start").agg(F.collect_list("q").alias("more"))
    whole = open_.join(more, ["item", "key", "start"], "left").withColumn("have", F.concat("have", F.coalesce("more", F.array().cast("array<int>"))))
    whole = whole.withColumn("s", F.expr("filter(s, x -> size(array_except(sequence(x, x + size - 1), have)) = 0)")).where(F.size("s") > 0)
    return whole.select("item", "key", F.expr("array_distinct(flatten(transform(s, x -> sequence(start + x, start + x + size - 1))))").alias("at"))


def proximity_matches(index: DataFrame, asked: DataFrame, slop: int) -> DataFrame:
    """``asked``: item, term (distinct). Places (item, key, pos) of each item's rarest term with a
    posting of every other term at most ``slop`` words away."""
    asked = asked.select("item", "term").distinct()
    counts = index.join(checked(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_postings"))
    asked = asked.join(counts, "term", "left").withColumn("n_postings", F.coalesce("n_postings", F.lit(0)))
    asked = materialize(
        asked.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("n_postings", "term"))).withColumn("n_terms", F.count("term").over(Window.partitionBy("item")))
    )
    lists = index.select("term", "key", "pos").distinct().join(checked(asked), "term")
    cell = F.floor(F.col("pos") / F.lit(slop + 1))
    anchor = lists.where("r = 1").select("item", "key", "n_terms", F.col("pos").alias("at"), cell.alias("cell"))
    other = lists.where("r > 1").select("item", "key", "term", "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = anchor.join(other, ["item", "key", "cell"], "left").where(F.col("pos").isNull() | (F.abs(F.col("pos") - F.col("at")) <= slop))
    near = near.groupBy("item", "key", "at", "n_terms").agg(F.size(F.collect_set("term")).alias("n_near"))
    return near.where(F.col("n_near") == F.col("n_terms") - 1).select("item", "key", F.col("at").alias("pos"))


def report(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """Per row of ``docs``: ident, n_words, n_hit, n_items, items_sha256, contaminated (and ``key``)."""
    asked = materialize(item_words(benchmark, item_id, item_text))
    index = build_index(docs, asked, ident, text)
    matches = materialize(phrase_matches(index, asked, span))
    names = benchmark.select(F.xxhash64(item_id, item_text).alias("item"), F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("name")).distinct()
    hit = matches.select("key", F.explode("at").alias("pos")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_hit"))
    items = matches.select("key", "item").distinct().join(names, "item").groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("items"))
    ends = index.where(F.col("term") == term(F.lit(END))).select(ident, "key", F.col("pos").cast("bigint").alias("n_words"))
    out = ends.join(hit.join(items, "key"), "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        ident, "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (PERCENT_INVERSE * n_hit >= F.col("n_words"))).alias("contaminated"), "key",
    )


def clean(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    bad = materialize(report(docs, benchmark, ident, text).where("contaminated").select(F.col("key").alias("__bad_key")).distinct())
    return docs.join(bad, F.xxhash64(docs[ident], docs[text]) == F.col("__bad_key"), "left_anti")
