"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every whole text is measured in its row; no words are exploded. Windows of eight words get a
64-bit hash by doubling (one word, two, four, eight), and only texts with a repeated window sort
theirs to find which words the repeats cover.

Cutoffs are not fixed: for each (lang, source) mergeable KLL sketches hold the distribution of each
measure, partial sketches are merged across tasks, and again to one per language. A group's quantiles are drawn
to its language's by a weight of ``FEW`` documents: the more documents a group has, the more its cutoffs are its
own, without a size at which they change. A measure is an outlier if it lies beyond median +- ``SPREADS`` times the distance
between the median and the quartile on the *other* side of the outliers, plus a slack; up to half
of a group can be junk without moving its cutoff. Thresholds are joined back and filter the rows.

Defined results: null text has no words; fewer than 20 words (so also empty and null texts) fails
the base rule; null lang or source is a group of its own; equal
measures are judged alike; very long texts are measured whole, in their row; repeated rows are judged alike; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.session import materialize

# Fixed values of the base rules.
WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SPREADS = 6.0
SKETCH_K = 1024  # about 0.2 % rank error
FEW = 50  # documents that the language's quantiles count for beside a group's own
# Measure -> (slack below, slack above); None: no such cutoff.
SLACKS: dict[str, tuple[float | None, float | None]] = {
    "mean_chars": (1.5, 3.0),
    "symbols_per_word": (None, 0.2),
    "dup_line_share": (None, 0.3),
    "repeat_share": (None, 0.15),
}


def _paired(hashes: str, apart: int, windows: Column) -> Column:
    """Hashes of windows twice as long from hashes of windows ``apart`` words long."""
    return F.zip_with(
        F.slice(hashes, F.lit(1), windows), F.slice(hashes, F.lit(apart + 1), windows), lambda a, b: F.xxhash64(a, b)
    )


def measure(docs: DataFrame, ident: str = "doc_id", text: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``ident``, ``keys`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words per row."""
    n = F.col("n_words")
    none = F.array().cast("array<bigint>")
    df = docs.select(ident, *keys, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.select(
        ident,
        *keys,
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
    )
    df = df.select(
        ident,
        *keys,
        "n_symbols",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    size = 1
    while size < WINDOW:
        count = (n - (2 * size - 1)).cast("int")
        df = df.withColumn(f"_h{2 * size}", F.when(count > 0, _paired(f"_h{size}", size, count)).otherwise(none)).drop(f"_h{size}")
        size *= 2
    last = f"_h{WINDOW}"
    repeats = F.size(F.array_distinct(last)) < F.size(last)
    placed = F.array_sort(F.transform(last, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(repeats, placed)).drop(last)
    # get() gives null outside the array, and <=> false against it
    twin = lambda x, i: x.h.eqNullSafe(F.get("_placed", i - 1).h) | x.h.eqNullSafe(F.get("_placed", i + 1).h)
    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_placed", twin), lambda x: x.i))).drop("_placed")
    steps = F.zip_with("_at", F.slice("_at", F.lit(2), F.size("_at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_at")


def with_shares(measured: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return measured.withColumns(
        {
            "mean_chars": per("word_chars", "n_words"),
            "symbols_per_word": per("n_symbols", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
        }
    )


def thresholds(shares: DataFrame, keys: tuple[str, str] = ("lang", "source"), few: int = FEW) -> DataFrame:
    """Per (lang, source): n_sketched and, for each measure, ``<measure>_low`` and ``<measure>_high``."""
    lang, source = keys
    sketches = shares.where("n_words > 0").groupBy(lang, source).agg(
        F.count(F.lit(1)).alias("n_sketched"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in SLACKS]
    )
    sketches = materialize(sketches)
    merged = sketches.groupBy(F.col(lang).alias("_lang")).agg(*[F.kll_merge_agg_double(m).alias(f"_{m}") for m in SLACKS])
    both = sketches.join(merged, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    out = [F.col(lang), F.col(source), F.col("n_sketched")]
    for m, (below, above) in SLACKS.items():
        own, shared = ([F.kll_sketch_get_quantile_double(c, F.lit(q)) for q in (0.25, 0.5, 0.75)] for c in (m, f"_{m}"))
        weight = F.col("n_sketched") / (F.col("n_sketched") + F.lit(few))
        low, mid, high = (b + weight * (a - b) for a, b in zip(own, shared))
        out.append((F.lit(None).cast("double") if below is None else mid - SPREADS * (high - mid) - below).alias(f"{m}_low"))
        out.append((F.lit(None).cast("double") if above is None else mid + SPREADS * (mid - low) + above).alias(f"{m}_high"))
    return both.select(*out)


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text", keys: tuple[str, str] = ("lang", "source"), few: int = FEW) -> DataFrame:
    """Every row with its measures, ``base_failed`` and ``kept``."""
    shares = with_shares(materialize(measure(docs, ident, text, keys)))
    cuts = materialize(thresholds(shares, keys, few)).withColumnsRenamed({k: f"_cut_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_cut_{k}")) for k in keys]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    outlier = F.lit(False)
    for m in SLACKS:
        for beyond in (F.col(m) < F.col(f"{m}_low"), F.col(m) > F.col(f"{m}_high")):
            outlier = outlier | F.coalesce(beyond, F.lit(False))
    return shares.join(cuts, match[0] & match[1], "left").select(
        ident, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~outlier).alias("kept"), *SLACKS,
    )
