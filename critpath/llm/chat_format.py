"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and written under one header per run of equal roles:

    <|im_start|>role<|im_sep|>text<|im_turn|>text<|im_end|>

Backslashes inside texts and roles are doubled and every control string gets a backslash after its first
character, so that no text can forge a marker and reading back is exact.

Defined results: a null text is the empty text, a null role the empty role; turns sort by (turn, role, text) with
nulls first, so ties and repeated rows stay and have one order; a null conv_id is a conversation of its own; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
#: What follows the first character of a control string: this template's markers and those of other public templates.
CONTROL_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + CONTROL_TAIL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + CONTROL_TAIL, "$1"), F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, segments (text, loss): the segments joined are the formatted chat, loss marks what is learned."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            escape(F.coalesce("role", F.lit(""))).alias("role"),
            escape(F.coalesce("text", F.lit(""))).alias("text"),
            F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def written(t: Column, i: Column) -> Column:
        before = F.get(F.col("ts"), i - 1)["role"]
        same = (i > 0) & (before == t["role"])
        head = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), t["role"], F.lit(SEP))
        return F.array(part(F.when(same, F.lit(TURN)).otherwise(head), F.lit(False)), part(t["text"], t["loss"]))

    segments = F.concat(F.flatten(F.transform("ts", written)), F.array(part(F.lit(END), F.lit(False))))
    return chats.select("conv_id", segments.alias("segments")).select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted chat, as they were before formatting."""
    q = lambda s: s.replace("|", r"\|")
    blocks = F.filter(F.split(formatted, q(END), -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        both = F.split(block, q(SEP), 2)
        role = unescape(F.substring(F.get(both, F.lit(0)), len(START) + 1, 1 << 30))
        return F.transform(F.split(F.get(both, F.lit(1)), q(TURN), -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
