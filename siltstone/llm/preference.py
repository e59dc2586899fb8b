"""Preference formatting with DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text both
equal) is rendered once as the prompt; what remains of either is its completion, with a mask: the spans of
its text that are learnt from, which are the assistant's words and the mark that ends them.

A conversation is the turns of one id, in order of turn, then role, then text; a row that repeats another is
the same turn. Null roles and texts are empty strings; a null turn number comes first. Rows without an id belong to no
conversation. Where one conversation is a prefix of the other, its completion is empty and has no spans.
An empty table gives no pairs. Columns besides those that are named are not read. A conversation is one
value of the result, so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def grouped(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", into: str = "turns") -> DataFrame:
    """One row for each conversation: its id, and an array of (role, text)."""
    turn = F.struct(
        F.coalesce(turns[turn_col].cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"),
        F.coalesce(turns[text_col], F.lit("")).alias("text"),
    )
    rows = turns.where(turns[id_col].isNotNull()).select(turns[id_col].alias("_id"), turn.alias("_turn"))
    ordered = rows.groupBy("_id").agg(F.array_sort(F.collect_set("_turn")).alias("_turns"))
    return ordered.select(F.col("_id").alias(id_col), F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(into))


def common_prefix(chosen: Column, rejected: Column) -> Column:
    """Turns at the beginning that both have."""
    differs = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] != b["role"]) | (a["text"] != b["text"]), F.lit(True)))
    at = F.array_position(differs, True)
    return F.when(at > 0, at - 1).otherwise(F.size(differs)).cast("long")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def learnt(turns: Column) -> Column:
    """Spans (start, end: code points, end exclusive) of the rendered turns that are learnt from."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc["at"] + len(OPEN) + F.length(t["role"]) + 1
        end = head + F.length(t["text"]) + len(CLOSE)
        span = F.struct(head.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, state, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", id_col: str = "pair_id") -> DataFrame:
    """pairs: an id and two arrays of (role, text). Gives n_prompt_turns, prompt, and text and mask of both completions. No shuffle."""
    split = pairs.select(F.col(id_col), F.col(chosen_col).alias("_c"), F.col(rejected_col).alias("_r"))
    split = split.withColumn("n_prompt_turns", common_prefix(F.col("_c"), F.col("_r")))
    n = F.col("n_prompt_turns").cast("int")
    rest = split.select(
        id_col, "n_prompt_turns", F.slice("_c", F.lit(1), n).alias("_p"),
        *(F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0))).alias(c) for c in ("_c", "_r")),
    )
    return rest.select(
        id_col, "n_prompt_turns", render(F.col("_p")).alias("prompt"),
        render(F.col("_c")).alias("chosen"), learnt(F.col("_c")).alias("chosen_mask"),
        render(F.col("_r")).alias("rejected"), learnt(F.col("_r")).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, id_col: str = "pair_id", **columns: str) -> DataFrame:
    """Of two tables of turns whose conversations are paired by id; ids that only one has make no pair."""
    both = grouped(chosen, id_col, into="_chosen", **columns).join(grouped(rejected, id_col, into="_rejected", **columns), id_col)
    return format_pairs(both, "_chosen", "_rejected", id_col)


def repeating(turns: Column) -> Column:
    """A worse conversation: the assistant's last turn only repeats its turn before, or else the turn before it. Null without the assistant."""
    places = F.transform(turns, lambda t: t["role"] == ASSISTANT)
    last = F.size(turns) + 1 - F.array_position(F.reverse(places), True)  # 1 too far on where there is none
    head = F.slice(turns, F.lit(1), F.greatest(last - 1, F.lit(0)).cast("int"))
    said = F.filter(head, lambda t: t["role"] == ASSISTANT)
    before = F.when(F.size(said) > 0, F.element_at(said, -1)["text"]).when(F.size(head) > 0, F.element_at(head, -1)["text"]).otherwise("")
    worse = F.transform(turns, lambda t, i: F.when(i + 1 == last, F.struct(t["role"].alias("role"), before.alias("text"))).otherwise(t))
    return F.when(F.array_contains(places, True), worse)
