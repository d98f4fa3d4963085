"""Turns and conversations.

Two shapes are in use. *Flat*: one row per turn ``(conv_id, turn, role, text)``. *Nested*: one row per conversation
``(conv_id, turns, …)`` with ``turns array<struct<turn,role,text>>`` in order. Steps that need no conversation as one
value stay on flat rows, so that a conversation of any length spreads over tasks. On nested rows every step is narrow.
``conv_id`` is unique per conversation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.text import has_text

TURNS_TYPE = "array<struct<turn:bigint,role:string,text:string>>"

# Turns of one conversation that are put together by one task before the conversation itself is.
PART_TURNS = 1024

# A row holds 2 GB; a nested conversation and its transcript are one value each.
MAX_BYTES = 2_000_000_000
_TURN_BYTES = 64  # of a nested turn beside its role and text
_NAMED = 20  # conversations an error names


def is_valid(role: Column, text: Column) -> Column:
    """A known role and a text that is not blank. Null, which no filter or count takes, where either is null."""
    return F.lower(role).isin(*fixed.VALID_ROLES) & has_text(text)


def map_roles(turns: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Translate another role vocabulary, e.g. ``{"user": "human", "assistant": "gpt"}``; other roles stay."""
    lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return turns.withColumn("role", F.coalesce(lookup[F.lower("role")], F.col("role")))


def with_defaults(turns: DataFrame) -> DataFrame:
    """Fill in what a turn leaves out, as a transcript renders it."""
    return turns.withColumns(
        {
            "role": F.coalesce("role", F.lit(fixed.UNKNOWN_ROLE)),
            "text": F.coalesce("text", F.lit("")),
        }
    )


def valid_turns(turns: DataFrame) -> DataFrame:
    return turns.filter(is_valid(F.col("role"), F.col("text")))


def clean_turns(conversations: DataFrame) -> DataFrame:
    """Keep the valid turns inside each nested conversation, in order, as they are."""
    return conversations.withColumn("turns", F.filter("turns", lambda t: is_valid(t["role"], t["text"])))


def at_least(conversations: DataFrame, min_turns: int = fixed.MIN_TURNS) -> DataFrame:
    """Nested conversations of ``min_turns`` turns or more."""
    return conversations.filter(F.size("turns") >= min_turns)


def project(conversations: DataFrame) -> DataFrame:
    """Only the identity and the turns of nested conversations."""
    return conversations.select("conv_id", "turns")


def turn_counts(turns: DataFrame) -> DataFrame:
    """Valid turns of every conversation, those with none included. Counts are summed before the shuffle."""
    valid = is_valid(F.col("role"), F.col("text"))
    return turns.groupBy("conv_id").agg(F.count_if(valid).alias("n_turns"))


def kept_ids(turns: DataFrame, min_turns: int = fixed.MIN_TURNS) -> DataFrame:
    return turn_counts(turns).filter(F.col("n_turns") >= min_turns).select("conv_id")


def part_no() -> Column:
    """Turns without a number are a part of their own."""
    return F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-1)).alias("part_no")


def kept_turns(turns: DataFrame, min_turns: int = fixed.MIN_TURNS) -> DataFrame:
    """Valid turns of conversations that have ``min_turns`` of them, still one row per turn.

    Turns meet their conversation's count by conversation and part of ``PART_TURNS`` turns, so that the turns of a very
    long conversation spread over as many tasks as it has parts. Sums per conversation are taken over parts."""
    valid = is_valid(F.col("role"), F.col("text"))
    parts = turns.groupBy("conv_id", part_no()).agg(F.count_if(valid).alias("n"))
    enough = F.sum("n").over(Window.partitionBy("conv_id")) >= min_turns
    kept = parts.withColumn("enough", enough).filter("enough").select("conv_id", "part_no")
    return (
        valid_turns(turns)
        .withColumn("part_no", part_no())
        .join(kept, ["conv_id", "part_no"], "left_semi")
        .drop("part_no")
    )


def discarded(turns: DataFrame, min_turns: int = fixed.MIN_TURNS) -> DataFrame:
    """Conversations with too few valid turns, and how many they have."""
    return turn_counts(turns).filter(F.col("n_turns") < min_turns)


def filter_counts(turns: DataFrame, min_turns: int = fixed.MIN_TURNS) -> DataFrame:
    """How many conversations the length filter keeps and discards."""
    enough = F.col("n_turns") >= min_turns
    return turn_counts(turns).agg(F.count_if(enough).alias("kept"), F.count_if(~enough).alias("discarded"))


def too_long(turns: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(conv_id, n_turns, n_bytes)`` of conversations that do not fit in one value of ``max_bytes``. Sizes are summed per
    conversation before the shuffle, and no text is moved."""
    size = F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)) + _TURN_BYTES
    sums = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(size.cast("bigint")).alias("n_bytes"))
    return sums.filter(F.col("n_bytes") > max_bytes)


def require_nestable(turns: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``turns`` as they are, or a ``ValueError`` that names the longest conversations of those that do not fit in one value, before anything
    is nested. ``too_long`` has all of them; leave them out with an anti-join, or keep to the steps on flat turns."""
    found = too_long(turns, max_bytes)
    worst = found.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("n_bytes"), "conv_id")
    rows = worst.limit(_NAMED).collect()
    if rows:
        named = ", ".join(f"{r.conv_id} ({r.n_turns} turns, {r.n_bytes} bytes)" for r in rows)
        raise ValueError(f"{rows[0].n} conversations are longer than {max_bytes} bytes: {named}")
    return turns


def nest_turns(turns: DataFrame) -> DataFrame:
    """Flat turns to nested conversations, in turn order, with one shuffle of the texts.

    Turns beyond the first ``PART_TURNS`` of a conversation are put together in parts by separate tasks before they
    meet, so the task that completes a very long conversation only strings parts together. The two kinds of rows are
    read apart, so give this a scan with filters, not the result of a join: the filter on ``turn`` reaches the scan,
    where it skips nearly all of a table of ordinary conversations. Turns without a number come first. A conversation is one value
    here: ``require_nestable`` tells beforehand whether all of them fit."""
    row = F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text")
    first = (F.col("turn") < PART_TURNS) | F.col("turn").isNull()
    head = turns.filter(first).select("conv_id", F.array(row).alias("part"))
    parts = (
        turns.filter(F.col("turn") >= PART_TURNS)
        .groupBy("conv_id", part_no())
        .agg(F.sort_array(F.collect_list(row)).alias("part"))
        .select("conv_id", "part")
    )
    return (
        head.unionByName(parts)
        .groupBy("conv_id")
        .agg(F.flatten(F.sort_array(F.collect_list("part"))).cast(TURNS_TYPE).alias("turns"))
    )


def flatten_turns(conversations: DataFrame) -> DataFrame:
    """Nested conversations to flat turns; no shuffle."""
    return conversations.select("conv_id", F.inline("turns"))


def with_position(turns: DataFrame) -> DataFrame:
    """Flat turns with their position in the conversation from 0, whatever their numbers are. Texts decide between equal
    numbers as they do in a nested conversation.

    A part's turns are numbered by themselves and moved up by the turns of the parts before, so a conversation of any
    length is never in one task."""
    within = Window.partitionBy("conv_id", "part_no").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv_id").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("conv_id", part_no()).agg(F.count("*").alias("n"))
    parts = parts.select("conv_id", "part_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = turns.withColumn("part_no", part_no()).withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(parts, ["conv_id", "part_no"]).select(
        "conv_id", (F.col("before") + F.col("nth")).cast("int").alias("position"), "turn", "role", "text"
    )
