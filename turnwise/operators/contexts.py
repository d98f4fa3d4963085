"""Transcripts, context strategies and how much they keep."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.numbers import round_half_even
from turnwise.functions.text import capitalize, last_tokens, n_tokens, strip, tail_tokens, tokens
from turnwise.operators.turns import PART_TURNS, part_no
from turnwise.sources.scratch import land, scratch_path

# A strategy makes a context out of a transcript and its tokens. It may wrap a pandas UDF.
Strategy = Callable[[Column, Column], Column]

BROADCAST_CUTS = 1 << 20  # long conversations whose cuts are broadcast; about 50 bytes each


def rendered(role: Column, text: Column) -> Column:
    """One turn as a line of the transcript."""
    return F.concat(
        capitalize(F.coalesce(role, F.lit(fixed.UNKNOWN_ROLE))),
        F.lit(fixed.ROLE_MARK),
        strip(F.coalesce(text, F.lit(""))),
    )


def rendered_tokens(role: Column, text: Column) -> Column:
    """Tokens of one turn's line, without making the line: those of its head, which is one for a valid role, and
    those of its text."""
    head = F.concat(F.coalesce(role, F.lit(fixed.UNKNOWN_ROLE)), F.lit(fixed.ROLE_MARK))
    n_head = F.when(F.lower(role).isin(*fixed.VALID_ROLES), F.lit(1)).otherwise(n_tokens(head))
    return n_head + n_tokens(F.coalesce(text, F.lit("")))


def transcript(turns: Column) -> Column:
    """The whole conversation as text, from nested turns."""
    return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), fixed.TURN_BREAK)


def default_strategies(truncation_tokens: int = fixed.TRUNCATION_TOKENS) -> dict[str, Strategy]:
    """``oracle`` keeps everything, ``baseline`` the last tokens; ``compressed`` is a slot for a policy of the user's
    and does what ``baseline`` does until one is put there."""

    def tail(text: Column, found: Column) -> Column:
        return tail_tokens(text, truncation_tokens, found)

    return {"oracle": lambda text, found: text, "baseline": tail, "compressed": tail}


def contexts(
    conversations: DataFrame, strategies: Mapping[str, Strategy] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per nested conversation and strategy: ``(conv_id, *keep, strategy, context, n_tokens)``; no shuffle.

    Contexts depend on the conversation only, so they are made here, before questions multiply the rows."""
    strategies = default_strategies() if strategies is None else strategies
    whole = conversations.select("conv_id", *keep, transcript(F.col("turns")).alias("text")).withColumn(
        "found", tokens(F.col("text"))
    )
    rows = whole.withColumn("strategy", F.explode(F.array(*[F.lit(name) for name in strategies])))
    text, found = F.col("text"), F.col("found")
    context = F.coalesce(
        *[F.when(F.col("strategy") == name, make(text, found)) for name, make in strategies.items()]
    )
    # Tokens are counted again only where a strategy changed the text.
    n = F.when(F.col("context") == text, F.size(found)).otherwise(n_tokens(F.col("context")))
    return (
        rows.withColumn("context", context)
        .withColumn("n_tokens", n)
        .select("conv_id", *keep, "strategy", "context", "n_tokens")
    )


def tail_cuts(turns: DataFrame, n_turns: int) -> DataFrame:
    """``(conv_id, cut)`` of conversations whose last ``n_turns`` turns all lie in the parts from number ``cut`` on, where ``cut`` is not
    their first part. Turns are counted by part, so only numbers are shuffled, and parts of a conversation are added up from its end."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("part_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The filter reaches the scan, where it skips nearly all of a table of ordinary conversations.
    later = turns.filter(F.col("turn") >= PART_TURNS).groupBy("conv_id", part_no()).agg(F.count("*").alias("n"))
    enough = later.withColumn("upto", F.sum("n").over(after)).filter(F.col("upto") >= n_turns)
    return enough.groupBy("conv_id").agg(F.max("part_no").alias("cut"))


def recent_parts(turns: DataFrame, n_turns: int, broadcast_rows: int = BROADCAST_CUTS) -> DataFrame:
    """Flat turns without the parts of long conversations that end before the last ``n_turns`` turns; all others as they are.

    Up to ``broadcast_rows`` cuts are broadcast, and turns stay where they are. Beyond, the turns of long conversations meet their cut by
    conversation and part, so that they spread over as many tasks as they have parts."""
    cuts = land(tail_cuts(turns, n_turns), scratch_path(turns.sparkSession, "cuts"))
    n = cuts.count()
    if not n:
        return turns
    marked = turns.withColumn("part_no", part_no())
    if n <= broadcast_rows:
        joined = marked.join(F.broadcast(cuts), "conv_id", "left")
        return joined.filter(F.col("cut").isNull() | (F.col("part_no") >= F.col("cut"))).select(*turns.columns)
    counted = marked.groupBy("conv_id", "part_no").agg(F.count("*").alias("n"))
    gone = counted.join(cuts, "conv_id").filter(F.col("part_no") < F.col("cut")).select("conv_id", "part_no")
    return marked.join(gone, ["conv_id", "part_no"], "left_anti").select(*turns.columns)


def tail_contexts(
    turns: DataFrame, truncation_tokens: int = fixed.TRUNCATION_TOKENS, min_turns: int = 1
) -> DataFrame:
    """The ``baseline`` context of conversations with ``min_turns`` turns, from flat turns: ``(conv_id, context)``.

    A rendered turn has at least one token, so the last ``truncation_tokens`` + 1 turns decide. Turns are counted by conversation and part
    first, and parts that end before those turns are left out where they lie. The rank limit drops all but those turns from each
    input partition before the shuffle. What one task gets of a conversation is bounded: those turns, and less than a part more."""
    if truncation_tokens < 1:
        raise ValueError(f"a tail needs at least one token, got {truncation_tokens}")
    # The reverse of the order turns have in a nested conversation, with roles and texts between equal numbers.
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    upto = latest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    keep = max(truncation_tokens + 1, min_turns)
    recent = (
        recent_parts(turns.select("conv_id", "turn", "role", "text"), keep)
        .withColumn("nth", F.row_number().over(latest))
        .filter(F.col("nth") <= keep)
        .withColumn("n", rendered_tokens(F.col("role"), F.col("text")))
        .withColumn("upto", F.sum("n").over(upto))
        .withColumn("all", F.sum("n").over(whole))
        .withColumn("n_turns", F.max("nth").over(whole))
    )
    cut = F.col("all") > truncation_tokens
    left = F.lit(truncation_tokens) - (F.col("upto") - F.col("n"))  # tokens this turn may still fill
    # Every token that is kept lies in `truncation_tokens` turns at most, so this list is bounded.
    pieces = (
        recent.filter((left > 0) & (F.col("n_turns") >= min_turns))
        .withColumns({"cut": cut, "left": left, "line": rendered(F.col("role"), F.col("text"))})
        .select("conv_id", "nth", "cut", "left", "line")
        .withColumn("found", F.when(F.col("cut"), tokens(F.col("line"))))
        .withColumn(
            "piece",
            F.when(F.col("cut"), last_tokens(F.col("found"), F.col("left").cast("int"))).otherwise(F.col("line")),
        )
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("nth"), "piece"))).alias("pieces"), F.first("cut").alias("cut"))
    )
    texts = F.col("pieces.piece")
    return pieces.select(
        "conv_id",
        F.when(F.col("cut"), F.array_join(texts, " "))
        .otherwise(F.array_join(texts, fixed.TURN_BREAK))
        .alias("context"),
    )


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0.0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def context_sizes(
    turns: DataFrame, truncation_tokens: int = fixed.TRUNCATION_TOKENS, min_turns: int = 1
) -> DataFrame:
    """``(conv_id, n_turns, oracle_tokens, baseline_tokens)`` from flat turns.

    Turns are separated by whitespace, so the tokens of a transcript are those of its lines, and a tail has as many
    as fit. Only counts are shuffled, summed per conversation before that."""
    return (
        turns.groupBy("conv_id")
        .agg(
            F.count("*").alias("n_turns"),
            F.sum(rendered_tokens(F.col("role"), F.col("text"))).alias("oracle_tokens"),
        )
        .filter(F.col("n_turns") >= min_turns)
        .withColumn("baseline_tokens", F.least("oracle_tokens", F.lit(truncation_tokens).cast("bigint")))
    )


def default_token_counts(
    turns: DataFrame, truncation_tokens: int = fixed.TRUNCATION_TOKENS, min_turns: int = 1
) -> DataFrame:
    """``(conv_id, strategy, n_tokens)`` of the default strategies from flat turns, without making a context: two of
    them are tails. Only counts are shuffled."""
    sizes = context_sizes(turns, truncation_tokens, min_turns)
    counts = {"oracle": "oracle_tokens", "baseline": "baseline_tokens", "compressed": "baseline_tokens"}
    rows = [F.struct(F.lit(s).alias("strategy"), F.col(c).cast("int").alias("n_tokens")) for s, c in counts.items()]
    return sizes.select("conv_id", F.inline(F.array(*rows)))


def with_compression_ratio(sizes: DataFrame) -> DataFrame:
    """Add what share of the tokens the tail keeps, rounded to four decimals."""
    share = ratio(F.col("baseline_tokens"), F.col("oracle_tokens"))
    return sizes.withColumn("compression_ratio", round_half_even(share, fixed.RATIO_DECIMALS))
