"""Conversations as training texts of bounded length: budgeted windows of whole turns (operator 13).

Only DataFrame functions are used. A conversation of any length is laid out by prefix sums of its
turns' tokens, which are summed in two levels, so that no task needs all turns of one conversation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.staging import stage

#: fixed values: the marks of the template
START, END = "<|im_start|>", "<|im_end|>"
#: what the marks and the line break after the role cost
MARK_TOKENS = 4
SEGMENT = 4096
KEYS = ["no_conv", "conv"]
WINDOW = "conv_id long, window long, text string, loss array<struct<start:int,length:int>>, n_turns int, n_repeated int"


def token_count(text: Column) -> Column:
    """Runs of at most six characters without white space and ASCII signs, and each sign by itself."""
    return F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,6}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"))


def escaped(text: Column) -> Column:
    """One more backslash in every '<', backslashes, '|': no escaped text holds '<|', and each has one original."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """As ``escaped``, with backslashes and line breaks spelt out before, so that a role is one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def place_turns(turns: DataFrame, budget: int, history: int, tokens: Callable[[Column], Column]) -> DataFrame:
    """Every turn once, with its window and ``at``, the tokens before it in its conversation (-1: the retained system turn)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.col("conv_id").isNull().alias("no_conv"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (tokens(role) + tokens(text) + MARK_TOKENS).cast("long").alias("size"),
    ).withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))))
    inside = W.partitionBy(*KEYS, "segment").orderBy("turn", "role", "text")
    local = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    kept = (F.col("nth") == 1) & (F.col("role") == "system") & (F.col("size") <= budget // 4)
    sums = local.groupBy(*KEYS, "segment").agg(F.sum("size").alias("total"), F.max(F.when(kept, F.col("size"))).alias("leads"))
    along = W.partitionBy(*KEYS).orderBy("segment")
    before = F.coalesce(F.sum("total").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    segments = sums.select(*KEYS, "segment", before.alias("before"), F.coalesce(F.first("leads").over(along.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).alias("system"))
    start = F.col("before") + F.col("upto") - F.col("size")
    is_system = (start == 0) & (F.col("system") > 0)
    room = F.lit(budget - history) - F.col("system")
    joined = local.join(segments, [*KEYS, "segment"]).withColumn("at", F.when(is_system, F.lit(-1)).otherwise(start - F.col("system"))).withColumn("room", room)
    span = F.floor(F.col("at") / F.floor(F.col("room") * 3 / 4))
    alone = (F.col("at") > 0) & (F.col("at") + F.col("size") - span * F.floor(F.col("room") * 3 / 4) > F.col("room"))
    lead = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    return joined.select(
        *KEYS,
        F.when(F.col("at") < 0, F.lit(0)).otherwise(2 * span + alone.cast("long")).cast("long").alias("window"),
        "at",
        F.concat(lead, body, F.lit(END + "\n")).alias("piece"),
        F.length(lead).alias("lead"),
        F.when(F.col("role") == "assistant", F.length(body)).alias("target"),
    )


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokens: Callable[[Column], Column] = token_count) -> DataFrame:
    """(conv_id, window, text, loss, n_turns, n_repeated): each conversation as texts of about ``budget`` tokens.

    ``turns(conv_id, turn, role, text)``; other columns are left out. The prefix sums of a
    conversation's tokens are cut into strides, and a window holds the turns that start in its
    stride, never a part of one; a turn that doesn't fit any more has a window of its own. Each
    window begins with the conversation's system turn (its first turn, if its role is 'system') and
    then repeats the turns of the last ``history`` tokens before it. ``loss`` lists the texts of
    assistant turns as code points of ``text``; repeated turns are masked, so each is a target once.
    ``n_repeated`` turns at the head of a window stood in an earlier one. Windows of a conversation are
    numbered upwards, with gaps.

    A window is over budget only where one turn alone is. A system turn of more than a quarter of the
    budget stands once and isn't repeated, so a window adds at most ``history + budget / 4`` tokens
    of repetition. Null texts and roles are empty ones; a null conv_id is a conversation of its own;
    turns with a null number come first; equal turn numbers go by role, then text, and repeated rows
    stand as often as they are there. An empty table gives no windows.
    """
    if not 0 <= history <= budget // 2:
        raise ValueError("history must lie between 0 and half the budget")
    placed = stage(place_turns(turns, budget, history, tokens), "chat-turns")
    said = placed.where("at >= 0")
    windows = said.groupBy(*KEYS, "window").agg(F.min("at").alias("first")).where("first > 0")
    part = [*KEYS, "window", "at", "piece", "lead", "target"]
    fresh = placed.select(*part, F.lit(True).alias("new"))
    system = placed.where("at < 0").drop("window").join(windows.drop("first"), KEYS).select(*part, F.lit(False).alias("new"))
    both = fresh.unionByName(system)
    if history:
        near = F.floor(F.col("first") / history)
        asked = windows.withColumn("part", F.explode(F.array(near - 1, near)))
        behind = said.drop("window").withColumn("part", F.floor(F.col("at") / history)).join(asked, [*KEYS, "part"])
        both = both.unionByName(behind.where((F.col("at") < F.col("first")) & (F.col("at") >= F.col("first") - history)).select(*part, F.lit(False).alias("new")))
    pieces = F.array_sort(F.collect_list(F.struct("at", "new", "lead", "target", "piece")))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(seen: Column, x: Column) -> Column:
        span = F.array(F.struct((seen["end"] + x["lead"]).alias("start"), x["target"].alias("length")))
        spans = F.when(x["new"] & x["target"].isNotNull(), F.concat(seen["spans"], span)).otherwise(seen["spans"])
        return F.struct((seen["end"] + F.length(x["piece"])).alias("end"), spans.alias("spans"))

    return both.groupBy(*KEYS, "window").agg(pieces.alias("l")).select(
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"),
        "window",
        F.array_join("l.piece", "").alias("text"),
        F.aggregate("l", start, add)["spans"].alias("loss"),
        F.size(F.filter("l", lambda x: x["new"])).alias("n_turns"),
        F.size(F.filter("l", lambda x: ~x["new"])).alias("n_repeated"),
    )


def parsed_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text, read from its marks alone."""
    raw = F.split(text, F.lit(r"<\|im_start\|>"))

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        begin = F.length(role) + 2
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(p, begin, F.length(p) - begin - len(END))).alias("text"))

    return F.transform(F.slice(raw, F.lit(2), F.greatest(F.size(raw) - 1, F.lit(0))), one)


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation what its windows say, read back from their texts and masks.

    A digest is over the whole conversation, so here (not in ``format_windows``) the new turns of one
    conversation meet in one row.
    """
    turns = F.slice(parsed_turns(F.col("text")), F.col("n_repeated") + 1, F.col("n_turns"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    target = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"]))), "")
    read = windows.select("conv_id", "window", F.size(turns).alias("n"), said.alias("said"), target.alias("target"), F.length("text").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "target"))).alias("l"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("l.target", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("l.said", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
