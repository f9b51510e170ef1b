import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from closura.llm import chat_format
from closura.llm.queries import PLANTED, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, size string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text)) + chat_format.PER_TURN


def by_conv(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(some, key=lambda x: x[:3])] for c, some in out.items()}


def digests(rows):
    out = {}
    for conv, turns in by_conv(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
    return out


def got_digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def parsed(text):
    """Role and text of every turn, read by a plain scanner."""
    out = []
    for piece in text.split("</turn>\n")[:-1]:
        assert piece.startswith("### ")
        role, _, said = piece[4:].partition(": ")
        out.append(tuple(re.sub(r"(?s)\\(.)", r"\1", x) for x in (role, said)))
    return out


def test_query_reads_back_whole_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]
    assert got_digests(QUERIES["op12_chat_format"](spark, sf)) == digests(rows)


ODD = ["", "\\", "\\\\", "</turn>", "</turn>\n", "\\</turn>\n", "###", "#######", "### user: x", "a: b", "<", "<\\/turn>", "é 日本 \n\n", "w " * 9, "#\\#", "</turn", ">\n", None]


@pytest.mark.parametrize("budget,history", [(60, 20), (30, 0), (25, 40), (10_000, 5)])
def test_windows(spark, budget, history):
    rng = random.Random(budget)
    roles = ["user", "assistant", "system", "a: b", "x:", None, "tool\n"]
    rows = []
    for conv in [*range(12), None]:
        if conv is None or conv % 3:
            rows.append((conv, 0, "system", "be " * rng.randrange(12)))
        for t in range(rng.randrange(1, 25)):
            rows.append((conv, t + 1, rng.choice(roles), "".join(rng.choice(ODD) or "" for _ in range(rng.randrange(6)))))
    df = frame(spark, rows)
    made = chat_format.windows(df, budget, history)
    assert got_digests(chat_format.digest(made)) == digests(rows)
    want = by_conv(rows)
    seen = {c: [] for c in want}
    for w in sorted(made.collect(), key=lambda w: w["first_turn"]):
        turns = want[w["conv_id"]]
        system = turns[:1] if turns[0][0] == "system" and len(turns) > 1 else []
        said = parsed(w["formatted"])
        new = said[w["n_repeated"] :]
        first = w["first_turn"] - 1
        assert turns[first : first + w["n_turns"]] == new == said[-w["n_turns"] :]
        seen[w["conv_id"]] += range(first, first + w["n_turns"])
        assert said[: len(system)] == system
        repeated = said[len(system) : max(w["n_repeated"], len(system))]
        body = max(first, len(system))
        assert repeated == turns[body - len(repeated) : body] and body - len(repeated) >= len(system)
        assert sum(size(t) for _, t in repeated) <= history
        before = turns[len(system) : body - len(repeated)]
        room = max(budget - history - sum(size(t) for _, t in system), 1)
        if before:  # what stands further back would not fit
            assert sum(size(t) for _, t in [before[-1], *repeated]) > min(history, room)
        assert w["n_tokens"] == sum(size(t) for _, t in said)
        fresh = new[len(system) :] if first < len(system) else new
        assert w["n_tokens"] <= budget or len(fresh) == 1 or room == 1
        spans = [re.sub(r"(?s)\\(.)", r"\1", w["formatted"][s["start"] : s["start"] + s["length"]]) for s in w["loss"]]
        assert spans == [t for r, t in new if r == "assistant"]
    assert all(sorted(at) == list(range(len(want[c]))) for c, at in seen.items())


def test_odd_tables(spark):
    one = [(1, 0, "system", "alone")]
    assert got_digests(chat_format.digest(chat_format.windows(frame(spark, one)))) == digests(one)
    same = [(2, 1, "assistant", "x")] * 3 + [(2, None, None, None), (2, 1, "assistant", "word " * 100_000)]
    got = chat_format.digest(chat_format.windows(frame(spark, same))).collect()[0]
    assert (got["n_turns"], got["loss_chars"]) == (5, 500_003)
    assert chat_format.digest(chat_format.windows(frame(spark, one).limit(0))).collect() == []


def test_a_long_conversation_is_spread(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("word number "), "id").alias("text"),
    )
    made = chat_format.windows(rows).where("conv_id = 1")
    assert made.agg(F.sum("n_turns"), F.max("n_tokens") <= chat_format.BUDGET).first()[:] == (6668, True)  # every third, and row 1 itself


def test_main_path_is_native(spark):
    rows = frame(spark, [(1, 0, "user", "x")])
    plan = chat_format.digest(chat_format.windows(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
