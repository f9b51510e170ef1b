import zlib

import pytest

from closura.llm import toxicity as tox
from closura.llm.queries import QUERIES


def test_query_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if i in labels and r["held_out"]]
    toxic = [p for label, p in held if label == 1]
    assert sum(toxic) / len(toxic) > 0.8 and not any(p for label, p in held if label == 0)


def test_labels_of_held_out_rows_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (sorted(tuple(r) for r in tox.judge(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.fixture
def grammar():
    return tox.Grammar({"idiot": 4.0, "fool": 3.0}, {"scum": 5.0, "scumm": 6.0})


@pytest.mark.parametrize(
    ("clause", "weight"),
    [
        ("an idiot here", 4.0), ("scumbag", 5.0), ("scummy", 6.0), ("scu", 0.0), ("you idiot", 5.0), ("not an idiot", 1.6),
        ("not one of all those idiot", 5.0), ("he said idiot", 3.0), ("he said you idiot", 0.6 * 4 * 1.25 + 0.0), ("kill", 0.0), ("kill you", 4.0),
        ("you kill", 4.0), ("kill the bug you", 4.0), ("never kill you", 4.0 * 1.0), ("idiot fool", 7.0), ("said kill you", 2.4), ("", 0.0),
    ],
)
def test_clauses(grammar, clause, weight):
    if clause == "he said idiot":
        weight = 4.0 * 0.6 * 1.25  # "he" is a target
    assert grammar.clause(clause.split()) == pytest.approx(weight)


def test_scope_ends_with_the_clause(grammar):
    total = lambda t: round(2.718281828459045 ** grammar.features(t)[0] - 1, 6)
    assert total("Not now. An IDIOT") == 4.0 and total("they said: an idiot") == 4.0
    assert grammar.features(None) == grammar.features("") == grammar.features("clean words only") == (0.0, 0.0)


def test_composition_runs_parts_side_by_side():
    both = tox.compose(tox.negation(), tox.threat())
    assert len(both.step) <= 4 * 4 and all(len(row) == 6 for row in both.step)
    state = both.step[0][tox.NEGATION]
    assert both.weight[state][tox.INSULT] == tox.NEGATED


def test_odd_rows(spark):
    docs = [(i, f"plain text {i}" if i % 2 else f"plain zorgling{i} text zorg{i}") for i in range(60)]
    docs += [(100, None), (101, ""), (None, "zorgx"), (5, "plain text 5"), (102, "word " * 60_000 + "zorgish")]
    df = spark.createDataFrame([(d, t, "en", 3) for d, t in docs], "doc_id long, text string, lang string, toxic int")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(0, 0), (7, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    got = tox.judge(df, labels).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert all(by[i] == 1 - i % 2 for i in range(60)) and by[100] == by[101] == 0 and by[None] == 1
    kept = tox.clean(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(1 - r["predicted"] for r in got)
    assert {r["score"] for r in tox.judge(df, labels.limit(0)).collect()} == {0.0}
    assert tox.judge(df.limit(0), labels).collect() == []


def test_words_of_a_rare_language_and_many_patterns_are_learned(spark):
    letters = "abcdefghij"
    insult = lambda i: "z" + "".join(letters[int(c)] for c in f"{i:04d}") + "q"
    docs = [(i, f"plain {letters[i % 10]}{letters[i // 10 % 10]}", 0) for i in range(2_000)]
    docs += [(i, "common grolk", 1) for i in range(2_000, 3_000)]  # nearly all toxic rows
    docs += [(i, "vulgo tontazo", 1) for i in range(3_000, 3_008)]  # 8 of 1,008, under 2 %
    words, starts = tox.patterns(spark.createDataFrame([(t, x) for _, t, x in docs], "text string, toxic int"))
    found = tox.Grammar(words, starts)
    assert found.classify("grolk")[0] == found.classify("tontazo")[0] == tox.INSULT and found.classify("plain")[0] == tox.OTHER
    many = [(f"{insult(i)}", 1) for i in range(2_500) for _ in range(4)] + [("clean words", 0)] * 90_000
    words, starts = tox.patterns(spark.createDataFrame([(t, x) for t, x in many], "text string, toxic int"))
    found = tox.Grammar(words, starts)
    assert all(found.classify(insult(i))[0] == tox.INSULT for i in range(2_500))


def test_chance_is_no_insult(spark):
    rows = [("word filler", k % 2) for k in range(200)] + [("rarity", 1)] * 4 + [("calm", 0)] * 40
    words, starts = tox.patterns(spark.createDataFrame(rows, "text string, toxic int"))
    found = tox.Grammar(words, starts)
    assert found.classify("rarity")[0] == found.classify("filler")[0] == tox.OTHER
