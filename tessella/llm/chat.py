"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, neighbours of one role are merged by
an array aggregation, and everything is concatenated:

    <|turn|>role<|text|>first text<|next|>second text<|end|>

Control strings cannot come from a text: a backslash is put
behind the first character of each, and backslashes are doubled, so unescape()
gives the text back. The loss mask is a list of code point ranges of the
formatted string that hold assistant texts, without any control string.

Edge cases: a null text or role is empty; turns with equal numbers are ordered
by role and text, null numbers come first; repeated rows are turns of their own;
rows without conversation id form one conversation; an empty table gives no
rows; other columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: How strings that steer chat templates, ours and common ones, begin and go on.
OPENERS, CONTROLS = r"[<\[]", r"\||/?s>|/?INST\]|</?SYS>>|/?(?:start|end)_of_turn>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, rf"({OPENERS})(?={CONTROLS})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED) -> DataFrame:
    """conv_id, formatted and loss (array of start and length in code points) for each conversation."""
    rows = turns.select(F.col(f"`{conv_id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    run = "struct<role:string,texts:array<string>>"
    one = lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))

    def merge(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        same = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["role"] == t["role"])
        return F.when(same, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(one(t))))

    merged = sorted_turns.select("conv_id", F.aggregate("turns", F.array().cast(f"array<{run}>"), merge).alias("runs"))
    # Parts of the formatted string, and whether the loss covers them.
    part = lambda s, loss: F.struct(s.alias("s"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))

    def parts(r: Column) -> Column:
        texts = F.flatten(F.transform(r["texts"], lambda x, i: F.array(part(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), False), part(escape(x), r["role"] == learned))))
        return F.concat(F.array(part(F.concat(F.lit(TURN), escape(r["role"]), F.lit(TEXT)), False)), texts, F.array(part(F.lit(END + "\n"), False)))

    laid = merged.select("conv_id", F.flatten(F.transform("runs", parts)).alias("parts"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))

    def measure(acc: Column, p: Column) -> Column:
        n = F.length(p["s"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(p["loss"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return laid.select("conv_id", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), F.aggregate("parts", zero, measure)["loss"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """Role and text of each turn of a formatted string."""

    def turns(run: Column) -> Column:
        cut = F.locate(TEXT, run)
        role = unescape(F.substring(run, F.lit(1), cut - 1))
        return F.transform(F.split(F.substr(run, cut + len(TEXT)), r"<\|next\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    runs = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.flatten(F.transform(runs, lambda r: turns(F.substr(r, F.lit(1), F.length(r) - len(END) - 1))))
