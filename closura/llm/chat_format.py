"""Chat formatting in budgeted windows, in DataFrame operations only.

Turns are put in order and their tokens summed up by chunks (``ordered_prefix``), so a conversation of any
length is spread over tasks. With ``room`` tokens beside the system turn and the history, prefix sums
cut a conversation into cells of ``room`` tokens. The turns that lie in a cell make a window, together
with the turn that crosses into the next cell if that fits, else that turn has its own. Every turn is thus
new in one window, and a window is over the budget only if a single turn is. In front of a window
stand the system turn (a first turn of role ``system``) and the turns before it that fit ``history`` tokens.

The loss mask (spans of code points) covers the text of the window's new ``assistant`` turns; the system turn
and repeated turns are masked out. Each turn reads ``### role: text</turn>`` and a line feed. Backslashes
break up these control strings wherever they stand in a role or text, so that the format reads back exactly.

Only a cell is ever gathered: at most ``room`` tokens, and every turn counts ``PER_TURN`` at least.

Defined results: null text or role is empty; null conversations are one conversation; null turn numbers
come first; equal turn numbers follow role and a hash of the text; repeated rows are turns of
their own; a conversation of a system turn alone has one window with it; very long texts are one turn
and never cut; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.operators.ordered import ordered_prefix
from closura.session import materialize

SYSTEM, TARGET = "system", "assistant"
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
# Control string -> how it reads inside a role or text; every backslash stands before a character meant as such.
ESCAPES = (("\\", "\\\\"), ("</turn>", "<\\/turn>"), ("##", "#\\#"))
PER_TURN = 4  # tokens of the control strings
BUDGET, HISTORY = 1024, 256
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(AFTER_ROLE), F.lit(":\\ "))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, "(?s)\\\\(.)", "$1")).otherwise(text)


def placed_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """Turns in order: _none, _conv (the conversation), rank, n, role and text as written, size in tokens and its prefix sum."""
    df = turns.select(
        F.col(conv).isNull().alias("_none"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("_conv"), F.col(conv).alias("conv"),
        F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    df = df.withColumns({"size": (tokens(F.col("text")) + PER_TURN).cast("bigint"), "_tie": F.xxhash64("role", "text"), "target": F.col("role") == TARGET, "is_system": F.col("role") == SYSTEM})
    df = df.withColumns({"role": escape_role(F.col("role")), "text": escape(F.col("text"))})
    return ordered_prefix(df, ["_none", "_conv"], [F.col("_turn").asc_nulls_first(), F.col("role"), F.col("_tie")], value="size")


def _written(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t.role, F.lit(AFTER_ROLE), t.text, F.lit(CLOSE))


def windows(
    turns: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    tokens: Callable[[Column], Column] = words,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per window: ``conv``, first_turn (rank of its first new turn), n_turns (new ones), n_repeated (turns
    before them), n_tokens, formatted, loss (spans: start, length)."""
    placed = placed_turns(turns, conv, turn, role, text, tokens)
    kept_system = F.col("is_system") & (F.col("rank") == 1) & (F.col("n") > 1)
    placed = materialize(placed.withColumn("kept_system", kept_system).drop("_turn", "_tie", "is_system", "n"))

    of = ["_none", "_conv"]
    systems = placed.where("kept_system").select(*of, F.struct("role", "text").alias("system"), F.col("size").alias("system_size"))
    sizes = systems.select(*of, "system_size")
    df = placed.where(~F.col("kept_system")).join(sizes, of, "left").withColumn("system_size", F.coalesce("system_size", F.lit(0).cast("bigint")))
    room = F.greatest(F.lit(budget - history) - F.col("system_size"), F.lit(1)).cast("bigint")
    end = F.col("cum").cast("bigint") - F.col("system_size")
    df = df.withColumns({"room": room, "end": end, "start": end - F.col("size")}).withColumn("cell", F.expr("start div room"))
    # a turn may be history of windows that begin in its own cell or, if near enough, in the next
    back = F.least(F.lit(history).cast("bigint"), F.col("room"))
    edge = (F.col("cell") + 1) * F.col("room")
    near = (F.col("start") >= edge - back) & (F.col("end") < edge + F.col("room"))
    own, copied = F.struct(F.col("cell").alias("cell"), F.lit(True).alias("own")), F.struct((F.col("cell") + 1).alias("cell"), F.lit(False).alias("own"))
    df = df.withColumn("at", F.explode(F.when(near, F.array(own, copied)).otherwise(F.array(own))))
    entry = F.struct("rank", "at.own", "role", "text", "target", "size", "start", "end")
    cells = df.groupBy(*of, F.col("at.cell").alias("cell")).agg(
        F.first("conv").alias("conv"), F.first("room").alias("room"), F.first("system_size").alias("system_size"), F.array_sort(F.collect_list(entry)).alias("all")
    )
    cells = cells.withColumn("own", F.filter("all", lambda t: t.own)).where(F.size("own") > 0)
    fits = F.get("own", F.size("own") - 1).end - F.get("own", F.lit(0)).start <= F.col("room")
    inner = F.filter("own", lambda t: t.end <= (F.col("cell") + 1) * F.col("room"))
    crossing = F.filter("own", lambda t: t.end > (F.col("cell") + 1) * F.col("room"))
    parts = F.when(fits, F.array("own")).otherwise(F.filter(F.array(inner, crossing), lambda w: F.size(w) > 0))
    df = cells.withColumn("new", F.explode(parts)).withColumn("first", F.get("new", F.lit(0)))
    reach = F.least(F.lit(history).cast("bigint"), F.col("room"))
    df = df.withColumn("before", F.filter("all", lambda t: (t.end <= F.col("first").start) & (t.start >= F.col("first").start - reach)))

    df = df.join(systems.drop("system_size"), of, "left")
    head = F.when(F.col("system").isNotNull(), F.array(_written(F.col("system")))).otherwise(F.array().cast("array<string>"))
    # the system turn is new in the window of the turn after it
    leads = F.col("system").isNotNull() & (F.col("first").rank == 2)
    repeated = F.concat(head, F.transform("before", _written))
    df = df.select(
        F.col("conv").alias(conv), F.when(leads, F.lit(1)).otherwise(F.col("first").rank).cast("bigint").alias("first_turn"),
        (F.size("new") + leads.cast("int")).cast("bigint").alias("n_turns"), (F.size(repeated) - leads.cast("int")).alias("n_repeated"),
        (F.col("system_size") + F.aggregate(F.concat("before", "new"), F.lit(0).cast("bigint"), lambda total, t: total + t.size)).alias("n_tokens"),
        F.array_join(repeated, "").alias("_head"), "new",
    )
    none = F.array().cast("array<struct<start:int,length:int>>")
    first = F.struct(F.length("_head").alias("at"), none.alias("spans"))

    def step(seen: Column, t: Column) -> Column:
        begin = seen.at + F.length(t.role) + len(OPEN) + len(AFTER_ROLE)
        span = F.struct(begin.alias("start"), F.length(t.text).alias("length"))
        spans = F.when(t.target, F.concat(seen.spans, F.array(span))).otherwise(seen.spans)
        return F.struct((begin + F.length(t.text) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return df.select(
        conv, "first_turn", "n_turns", "n_repeated", "n_tokens",
        F.concat("_head", F.array_join(F.transform("new", _written), "")).alias("formatted"),
        F.aggregate("new", first, step, lambda seen: seen.spans).alias("loss"),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per window, from its text alone: ``turns`` (role, text; the new ones) and ``targets`` (texts under the loss mask)."""
    pieces = F.split("formatted", CLOSE, -1)
    df = formatted.withColumn("_new", F.slice(pieces, F.col("n_repeated") + 1, F.col("n_turns").cast("int")))

    def parsed(piece: Column) -> Column:
        colon = F.locate(AFTER_ROLE, piece)
        role = F.substr(piece, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, colon + len(AFTER_ROLE))).alias("text"))

    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s.start + 1, s.length)))
    return df.select(conv, "first_turn", "formatted", F.transform("_new", parsed).alias("turns"), under.alias("targets"))


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows. A digest of a whole
    conversation needs its texts in one place; the windows themselves never do."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    df = read_back(formatted, conv).select(
        conv, "first_turn", F.size("turns").alias("n"), F.length("formatted").cast("bigint").alias("chars"), said.alias("said"), F.array_join("targets", "").alias("learned")
    )
    df = df.groupBy(conv).agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"),
        F.array_sort(F.collect_list(F.struct("first_turn", "said", "learned"))).alias("parts"),
    )
    learned = F.array_join("parts.learned", "")
    return df.select(
        conv, "n_turns", F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"), F.length(learned).cast("bigint").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
