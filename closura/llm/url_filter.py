"""URL filters: allow and block rules by host and path, and a naive Bayes verdict for all other urls.

Host labels run words together ("cheappills"). A unigram model counts the words of the pages' own
text; the best split of a label into words is found by Viterbi. A word costs minus the logarithm of
its share; an unknown piece costs as much as a single count spread over ten times as many letters for
each further letter, so known words win and any label can be split. Every distinct run of letters meets the
counts of all its substrings in a join, so the whole vocabulary counts, whatever its size.

Multinomial naive Bayes over the words of host and path is trained on the urls that a rule decides and
judges those that none does. Runs of digits count as one token. Token counts are summed by Spark over
all pages; every distinct host and token is worked out once, and pages join them.

Defined results: null urls and urls without ``://`` have empty host and path and no words: the prior
decides; a host that a rule fits is matched at whole labels only; rules of equal length cannot both
fit; repeated rows are judged alike; with rules that decide only one way that verdict is given; with no
decided url everything is allowed; equal splits go to the longest last word; very long names are split whole; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.llm.decontaminate import checked
from closura.session import materialize

ALLOW, BLOCK = "allow", "block"
# Fixed values: (verdict, host, path) of the rules.
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 24  # letters of a word
DIGITS = "0"  # stands for any run of digits
TOKEN = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def decided(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, begins in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(begins)
        out = F.when(fits, F.struct(F.lit(of + begins).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Segmenter:
    """Best splits of letters into words by a unigram model."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: of all counts, if ``counts`` are some of them."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = math.log(total)
        self.per_letter = math.log(10)

    def split(self, letters: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(letters) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = letters[start:end]
                cost = self.cost.get(word, self.unknown + self.per_letter * (end - start))
                options.append((best[start] + cost, start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(letters)
        while end:
            out.append(letters[back[end] : end])
            end = back[end]
        return out[::-1]

    def tokens(self, name: str | None) -> list[str]:
        return [t for run in runs_of(name) for t in ([run] if run == DIGITS else self.split(run))]


def runs_of(name: str | None) -> list[str]:
    """The runs of letters of a name, lower-cased; each run of digits is one sign."""
    return [DIGITS if run[0].isdigit() else run for run in TOKEN.findall((name or "").lower())]


def substrings(run: str) -> set[str]:
    return {run[at : at + n] for at in range(len(run)) for n in range(1, min(LONGEST, len(run) - at) + 1)}


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """w, c: all words of the pages' text, tags left out."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?s)<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where(F.length("w") <= LONGEST)
    return materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("c")))


def split_runs(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """run, tokens of the distinct ``runs``: each is handed the counts of the words among its own substrings, so all
    words of the corpus count and none of them pass the driver."""
    total = int(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])

    @F.pandas_udf("array<string>")
    def parts(runs: pd.Series) -> pd.Series:
        return pd.Series([list(substrings(r)) for r in runs], dtype=object)

    @F.pandas_udf("array<string>")
    def split(runs: pd.Series, words: pd.Series, found: pd.Series) -> pd.Series:
        own = (Segmenter(dict(zip(w, c, strict=True)), total).split(r) for r, w, c in zip(runs, words, found, strict=True))
        return pd.Series(list(own), dtype=object)

    letters = runs.where(F.col("run") != DIGITS)
    known = letters.select("run", F.explode(parts("run")).alias("w")).join(counts, "w").groupBy("run").agg(F.collect_list(F.struct("w", "c")).alias("words"))
    none = F.array().cast("array<struct<w:string,c:bigint>>")
    known = letters.join(known, "run", "left").withColumn("words", F.coalesce("words", none))
    out = known.select("run", split("run", F.col("words.w"), F.col("words.c")).alias("tokens"))
    return materialize(out.union(runs.where(F.col("run") == DIGITS).select("run", F.array("run"))))


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """ident, host, path, rule, verdict (and the log-odds of blocking by naive Bayes) of every row."""

    @F.pandas_udf("array<string>")
    def runs(names: pd.Series) -> pd.Series:
        return pd.Series([runs_of(n) for n in names], dtype=object)

    rows = pages.select(F.col(ident).alias("ident"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("by", decided(F.col("host"), F.col("path"), rules))
    # equal urls are counted once, with the number of their rows
    urls = materialize(rows.groupBy("host", "path", "by").agg(F.count(F.lit(1)).alias("n")))
    split = materialize(urls.select("host", "path", "n", "by", F.explode_outer(F.concat(runs("host"), runs("path"))).alias("run")))
    pieces = split_runs(split.where("run IS NOT NULL").select("run").distinct(), word_counts(pages, html))
    split = materialize(split.join(pieces, "run", "left"))

    block = (F.col("by.verdict") == BLOCK).cast("bigint")
    seen = split.where("by IS NOT NULL")
    n, n_block = urls.where("by IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * block), F.lit(0))).first()
    counts = seen.select(F.explode("tokens").alias("token"), "n", (F.col("n") * block).alias("b")).groupBy("token").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    counts = materialize(counts)
    all_, all_block, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count(F.lit(1))).first()
    share = lambda part, whole: F.log((part + 1.0) / F.lit(float(whole + kinds + 1)))
    odds = counts.select("token", (share(F.col("b"), all_block) - share(F.col("n") - F.col("b"), all_ - all_block)).alias("odds"))
    unseen = math.log((all_ - all_block + kinds + 1) / (all_block + kinds + 1))
    prior = 0.0 if not 0 < n_block < n else math.log(n_block / (n - n_block))

    each = split.where("by IS NULL").select("host", "path", F.explode("tokens").alias("token")).join(checked(odds), "token", "left")
    summed = each.groupBy("host", "path").agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias("odds"))
    out = rows.join(checked(materialize(summed)), ["host", "path"], "left")
    total = F.coalesce("odds", F.lit(0.0)) + prior
    learned = F.lit(BLOCK if n and n == n_block else ALLOW) if not 0 < n_block < n else F.when(total > 0, BLOCK).otherwise(ALLOW)
    return out.select(
        F.col("ident").alias(ident), "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", learned).alias("verdict"),
        F.when(F.col("by").isNull(), total).alias("log_odds"),
    )
