"""Turns of conversations: windows over message tables (conv_id, turn, role, content).

``turn`` is a message's place in its conversation; the derived ``turn_idx`` counts user turns. Messages before
the first user message belong to turn 0. All windows are within a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwright.functions import text as tx
from turnwright.functions.text import strip

KEY = ["conv_id", "turn_idx"]


def user_turns(messages: DataFrame) -> DataFrame:
    """Add ``turn_idx``."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    users = F.sum((F.coalesce(F.col("role"), F.lit("")) == "user").cast("int")).over(w)
    return messages.withColumn("turn_idx", F.greatest(users - 1, F.lit(0)).cast("long"))


def turn_array(messages: Column) -> Column:
    """The turn of each message of an array of (role, content)."""
    zero = F.struct(F.lit(-1).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        n = acc["n"] + (m["role"] == "user").cast("int")
        return F.struct(n.alias("n"), F.concat(acc["out"], F.array(F.greatest(n, F.lit(0)))).alias("out"))

    return F.aggregate(messages, zero, step, lambda acc: acc["out"])


def summary(turned: DataFrame) -> DataFrame:
    """First user text that is not empty, assistant and tool texts, and the calls of all assistant texts, of each turn."""
    text = F.coalesce(F.col("content"), F.lit(""))
    at = lambda role: (F.col("role") == role) & (text != "")
    listed = lambda role: F.transform(
        F.array_sort(F.collect_list(F.when(at(role), F.struct("turn", text.alias("t"))))), lambda s: s["t"]
    )
    out = turned.groupBy(*KEY).agg(
        F.coalesce(F.min_by(text, F.when(at("user"), F.col("turn"))), F.lit("")).alias("user_text"),
        listed("assistant").alias("assistant_texts"),
        listed("tool").alias("tool_texts"),
    )
    return out.withColumn("tool_calls", F.flatten(F.transform("assistant_texts", tx.tool_calls)))


def prompt_prefix(turned: DataFrame) -> DataFrame:
    """Messages and characters before each turn's answer: all earlier turns and the turn up to its first user message.

    A turn without a user message counts whole. Running sums at the cut replace a join of turns with messages."""
    text = F.length(F.coalesce("content", F.lit("")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    t = Window.partitionBy(*KEY)
    cut = F.coalesce(F.min(F.when(F.col("role") == "user", F.col("turn"))).over(t), F.max("turn").over(t))
    run = turned.select(*KEY, "turn", F.count(F.lit(1)).over(w).alias("n_msgs"), F.sum(text).over(w).alias("n_chars"), cut.alias("cut"))
    return run.where(F.col("turn") == F.col("cut")).select(*KEY, "n_msgs", "n_chars")


def future_suffix(turned: DataFrame) -> DataFrame:
    """Messages and characters of all later turns."""
    text = F.length(F.coalesce("content", F.lit("")))
    per = turned.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum(text).alias("c"))
    after = Window.partitionBy("conv_id").orderBy("turn_idx").rowsBetween(1, Window.unboundedFollowing)
    later = lambda c: F.coalesce(F.sum(c).over(after), F.lit(0)).cast("long")
    return per.select(*KEY, later("n").alias("n_msgs"), later("c").alias("n_chars"))


def prefix_of(messages: Column, k: int) -> Column:
    """The prompt prefix of turn k of an array of (role, content)."""
    turns = turn_array(messages)
    pos = F.sequence(F.lit(0), F.size(messages) - 1)
    users = F.filter(pos, lambda i: (F.get(turns, i) == k) & (F.get(messages, i)["role"] == "user"))
    mine = F.filter(pos, lambda i: F.get(turns, i) == k)
    cut = F.coalesce(F.array_min(users), F.array_max(mine), F.lit(-1))
    return F.when(F.size(messages) > 0, F.slice(messages, 1, cut + 1)).otherwise(messages)


def first_assistant(turned: DataFrame) -> DataFrame:
    """The first assistant message of each turn that has one."""
    said = turned.where(F.col("role") == "assistant").groupBy(*KEY)
    return said.agg(F.min("turn").alias("turn"), F.min_by("content", "turn").alias("content"))


def tool_or_last(turned: DataFrame) -> DataFrame:
    """The first assistant message with a tool call, else the last assistant message."""
    said = turned.where(F.col("role") == "assistant")
    called = F.when(F.col("content").contains("<tool_call>"), F.col("turn"))
    both = said.groupBy(*KEY).agg(
        F.min(called).alias("_t"), F.min_by("content", called).alias("_c"), F.max("turn").alias("_l"), F.max_by("content", "turn").alias("_m")
    )
    return both.select(
        *KEY,
        F.coalesce("_t", "_l").alias("turn"),
        F.when(F.col("_t").isNotNull(), F.col("_c")).otherwise(F.col("_m")).alias("content"),
        F.col("_t").isNotNull().alias("has_tool"),
    )


def as_arrays(messages: DataFrame) -> DataFrame:
    """One row a conversation with its messages in order."""
    m = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    out = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    return out.withColumn("messages", F.transform("messages", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))


def rendered_prompt(messages: Column) -> Column:
    """``role: content`` lines."""
    line = lambda m: F.concat(strip(F.coalesce(m["role"], F.lit("user"))), F.lit(": "), strip(F.coalesce(m["content"], F.lit(""))))
    return strip(F.array_join(F.transform(messages, line), "\n"))


def first_user(messages: Column) -> Column:
    """Content of the first user message; null without one or where it is empty."""
    said = F.get(F.filter(messages, lambda m: m["role"] == "user"), 0)["content"]
    return F.when(said != "", said)


def through_first_user(messages: Column) -> Column:
    """The messages up to and with the first user message; none without one."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "user").cast("int")
    return F.slice(messages, F.lit(1), at)


def end_positions(turned: DataFrame) -> DataFrame:
    """Where each turn ends."""
    return turned.groupBy(*KEY).agg(F.max("turn").alias("end_pos"))


def mask_positions(mask: Column) -> Column:
    """Indices of a mask that are not 0; the k-th is the end of turn k."""
    return F.when(
        F.size(mask) > 0, F.filter(F.sequence(F.lit(0), F.size(mask) - 1), lambda i: F.get(mask, i) != 0)
    ).otherwise(F.array().cast("array<int>"))
