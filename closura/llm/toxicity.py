"""Toxicity by a weighted finite-state pattern grammar.

Insults are learned from labelled rows: for words and word beginnings (inflected forms share one)
the log-odds of standing in a toxic text, counted by Spark over all labelled training rows. The
chosen patterns form the insult transducer. It is composed with transducers for threats, targets,
negation and reported speech into one automaton over word classes, which reads the clauses that
hold an insult or a threat: a target before or after raises the weight of what follows, negation
lowers it for a few words, reported speech for the rest of the clause, and a threat weighs only
with a target. A text is scored by the weights of its matched clauses, in total and per hundred
words; a logistic curve over these two, fitted on counts of the training rows, turns them into a
probability.

A pattern needs ``MIN_ROWS`` toxic texts, ``MIN_ODDS`` and significance, at every size; the lexicon has
all that pass and no shorter one covers. Labelled rows are bounded by ``MAX_LABELLED`` (beyond it, a
share of them chosen by hash is used), so that they can be sent to every task. Scoring is row by row.

Defined results: null and empty texts have no clause and get the score of such texts; a document
with several labels counts as toxic if one says so; labels that are null or of unknown documents are
ignored; without labelled rows every score is 0; repeated rows are scored alike; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.llm.bpe import texts_of
from closura.llm.decontaminate import checked
from closura.session import materialize

THRESHOLD = 0.7
MAX_LABELLED = 500_000
MIN_ROWS = 4  # toxic texts that hold a pattern
MIN_ODDS = 2.5
SIGNIFICANT = 15.137  # of the log-likelihood ratio: 1 in 10,000 by chance
PREFIXES = range(3, 11)

# Word classes of the grammar.
THREATS = frozenset("kill hurt destroy shoot stab burn hang beat punish töten vernichten tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset(
    "you your yours yourself he him his she her they them their those these people everyone "
    "du dich dir ihr euch sie ihnen tu toi te vous ils elles eux tú ti usted ustedes ellos ellas".split()
)
NEGATIONS = frozenset("not no never neither nor isn aren wasn don doesn nicht kein keine nie pas jamais aucun ni nunca jamás ningún".split())
REPORTS = frozenset(
    "said says saying wrote writes called calls quoted quotes reported reports according claimed claims "
    "sagte schrieb nannte laut dit écrit selon dijo escribió según".split()
)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
NEGATION_REACH = 3
NEGATED, REPORTED, TARGETED = 0.4, 0.6, 1.25
THREAT_WEIGHT = 4.0


@dataclass(frozen=True)
class Transducer:
    """step[state][word class] is the next state; weight[state][word class] scales what is read."""

    step: list[list[int]]
    weight: list[list[float]]


def _plain(n: int) -> list[list[float]]:
    return [[1.0] * 6 for _ in range(n)]


def negation() -> Transducer:
    step = [[max(0, s - 1)] * 6 for s in range(NEGATION_REACH + 1)]
    weight = _plain(NEGATION_REACH + 1)
    for s in range(NEGATION_REACH + 1):
        step[s][NEGATION] = NEGATION_REACH
        if s:
            weight[s][INSULT] = weight[s][THREAT] = NEGATED
    return Transducer(step, weight)


def _flag(raised_by: int, factor: float, classes: Iterable[int]) -> Transducer:
    """Raised for the rest of the clause once a word of the class was read."""
    step = [[0] * 6, [1] * 6]
    step[0][raised_by] = 1
    weight = _plain(2)
    for c in classes:
        weight[1][c] = factor
    return Transducer(step, weight)


def threat() -> Transducer:
    """0: nothing yet, 1: a target, 2: a threat waits for its target, 3: said. The threat weighs at its target."""
    step = [[s] * 6 for s in range(4)]
    step[0][TARGET], step[0][THREAT], step[1][THREAT], step[2][TARGET] = 1, 2, 3, 3
    weight = _plain(4)
    for s in (0, 2, 3):
        weight[s][THREAT] = 0.0
    for s in (0, 1, 3):
        weight[s][TARGET] = 0.0
    return Transducer(step, weight)


def compose(*parts: Transducer) -> Transducer:
    """The parts run side by side: states are tuples, weights multiply. Start: state 0."""
    states, at, step, weight = [(0,) * len(parts)], {(0,) * len(parts): 0}, [], []
    for state in states:
        step.append([])
        weight.append([])
        for c in range(6):
            after = tuple(p.step[s][c] for p, s in zip(parts, state, strict=True))
            if after not in at:
                at[after] = len(states)
                states.append(after)
            step[-1].append(at[after])
            weight[-1].append(float(np.prod([p.weight[s][c] for p, s in zip(parts, state, strict=True)])))
    return Transducer(step, weight)


@dataclass
class Grammar:
    """``words`` and ``prefixes``: insult patterns and their weights; ``curve``: bias and two slopes."""

    words: dict[str, float]
    prefixes: dict[str, float]
    curve: tuple[float, float, float] | None = None
    automaton: Transducer = field(default_factory=lambda: compose(negation(), _flag(REPORT, REPORTED, (INSULT, THREAT, TARGET)), _flag(TARGET, TARGETED, (INSULT,)), threat()))

    def __post_init__(self):
        self.seen: dict[str, tuple[int, float]] = {}

    def classify(self, word: str) -> tuple[int, float]:
        """Class and weight; the longest insult pattern decides."""
        if (known := self.seen.get(word)) is not None:
            return known
        out = (OTHER, 0.0)
        if word in self.words:
            out = (INSULT, self.words[word])
        elif hit := next((p for n in reversed(PREFIXES) if len(word) >= n and (p := word[:n]) in self.prefixes), None):
            out = (INSULT, self.prefixes[hit])
        else:
            for c, members in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
                if word in members:
                    out = (c, THREAT_WEIGHT if c in (THREAT, TARGET) else 0.0)
        if len(self.seen) > 100_000:
            self.seen.clear()
        self.seen[word] = out
        return out

    def clause(self, words: Iterable[str]) -> float:
        state, total = 0, 0.0
        for word in words:
            c, weight = self.classify(word)
            total += weight * self.automaton.weight[state][c]
            state = self.automaton.step[state][c]
        return total

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the total weight, and of that per hundred words."""
        lowered = (text or "").lower()
        words = WORD.findall(lowered)
        if not any(self.classify(w)[0] in (INSULT, THREAT) for w in set(words)):
            return 0.0, 0.0
        total = sum(self.clause(WORD.findall(c)) for c in CLAUSE.split(lowered))
        return float(np.log1p(total)), float(np.log1p(100 * total / len(words)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.seen = {}


def held_out(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, ident: str, text: str) -> DataFrame:
    known = labels.where(F.col("toxic").isNotNull() & F.col(ident).isNotNull() & ~held_out(F.col(ident)))
    known = materialize(known.groupBy(F.col(ident).alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic")))
    n = known.count()
    if n > MAX_LABELLED:  # a share chosen by hash, so that the rows can be broadcast
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(n)) < MAX_LABELLED)
    return docs.select(F.col(ident).alias("__id"), F.col(text).alias("text")).join(checked(known, 2 * MAX_LABELLED), "__id").select("text", F.col("__toxic").alias("toxic"))


def ratio(t: Column, n: Column, share: float) -> Column:
    """Log-likelihood ratio of t toxic ones of n against the share of all rows."""
    return 2 * sum(F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(0.0) for k, p in ((t, share), (n - t, 1 - share)))


def prune(chosen: pa.Table) -> pa.Table:
    """form, t, odds of all forms with the same first letters, without those that a shorter kept one covers
    or a longer one replaces."""
    found = {r["form"]: (r["t"], r["odds"]) for r in chosen.to_pylist()}
    longer: dict[str, int] = {}  # the best support of a form that is longer by a letter or a word's end
    for form, (support, _) in found.items():
        longer[form[:-1]] = max(longer.get(form[:-1], 0), support)
    kept: dict[str, float] = {}
    for form in sorted(found, key=len):
        support, weight = found[form]
        covered = any(kept.get(form[:k], 0.0) >= weight - 0.7 for k in range(1, len(form)))
        if not covered and longer.get(form, 0) < 0.9 * support:
            kept[form] = weight
    return pa.table([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.float64())], ["form", "odds"])


def patterns(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """rows: text, toxic. Weighted words and prefixes."""
    n, t = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < t < n:
        return {}, {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = rows.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    # a word is marked by a final blank, so that it differs from the prefix
    forms = F.concat(F.array(F.concat("word", F.lit(" "))), F.transform(F.filter(F.lit(list(PREFIXES)), lambda k: k <= F.length("word")), lambda k: F.substring(F.col("word"), F.lit(1), k)))
    counted = words.select("t", "n", F.explode(forms).alias("form")).groupBy("form").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where(F.col("t") >= MIN_ROWS)
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - t + 1))
    chosen = counted.where((odds >= MIN_ODDS) & (ratio(F.col("t"), F.col("n"), t / n) >= SIGNIFICANT)).select("form", "t", odds.alias("odds"))
    # forms cover each other only within the same shortest prefix
    kept = dict(chosen.groupBy(F.substring("form", 1, PREFIXES[0])).applyInArrow(prune, "form string, odds double").collect())
    return {f[:-1]: w for f, w in kept.items() if f[-1] == " "}, {f: w for f, w in kept.items() if f[-1] != " "}


def fit_curve(cells: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on rows (x1, x2, toxic, rows) by Newton steps with a slight ridge."""
    x = np.c_[np.ones(len(cells)), cells[:, :2]]
    p, n = cells[:, 2], cells[:, 3]
    w, ridge = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * q * (1 - q))) @ x + ridge, x.T @ (p - n * q) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> Grammar:
    """Learn from the labelled rows that are not held out."""
    rows = _labelled(docs, labels, ident, text)
    grammar = Grammar(*patterns(rows))

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(map(grammar.features, texts_of(texts)), pa.list_(pa.float64()))

    made = rows.select("toxic", features("text").alias("x"))
    cells = made.groupBy(F.round(F.col("x")[0], 1).alias("a"), F.round(F.col("x")[1], 1).alias("b")).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    cells = np.array([tuple(r) for r in cells.collect()], dtype=float)  # both features are below 20: at most 200 x 200 cells
    if len(cells):
        grammar.curve = fit_curve(cells)
    return grammar


def score(grammar: Grammar, text: Column) -> Column:
    if grammar.curve is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        x = np.array([grammar.features(t) for t in texts_of(texts)], dtype=float).reshape(-1, 2)
        bias, a, b = grammar.curve
        return pa.array(1 / (1 + np.exp(-np.clip(bias + x @ np.array([a, b]), -30, 30))))

    return probability(text)


def judge(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, held_out, score, predicted of every row."""
    scored = docs.select(ident, score(fit(docs, labels, ident, text), docs[text]).alias("score"))
    return scored.select(ident, held_out(F.col(ident)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not judged toxic, with all their columns."""
    marked = docs.withColumn("__score", score(fit(docs, labels, ident, text), docs[text]))
    return marked.where(F.col("__score") < THRESHOLD).drop("__score")
