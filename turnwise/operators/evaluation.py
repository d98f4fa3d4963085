"""Result rows, per-method summary and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.functions import fixed
from turnwise.functions.numbers import round_half_even
from turnwise.operators.contexts import ratio

_FIXED_COLUMNS = "conversation_id string, qa_idx int, question string, ground_truth string"


def result_schema(strategies: Sequence[str] = fixed.STRATEGIES) -> str:
    """The columns of a stored result, in order, as DDL."""
    return ", ".join(
        [
            _FIXED_COLUMNS,
            *[f"`{s}_score` double" for s in strategies],
            "recovery_rate double, compression_ratio double",
            *[f"`{s}_answer` string" for s in strategies],
            *[f"`{s}_tokens` int" for s in strategies],
        ]
    )


RESULT_SCHEMA = result_schema()


def with_derived(results: DataFrame) -> DataFrame:
    """Add ``recovery_rate`` and ``compression_ratio``, rounded to four decimals; 0.0 where the divisor is, and null
    where the strategies they compare are not there."""

    def rate(part: str, whole: str) -> Column:
        if part not in results.columns or whole not in results.columns:
            return F.lit(None).cast("double")
        return round_half_even(ratio(F.col(part), F.col(whole)), fixed.RATIO_DECIMALS)

    return results.withColumns(
        {
            "recovery_rate": rate("compressed_score", "oracle_score"),
            "compression_ratio": rate("baseline_tokens", "oracle_tokens"),
        }
    )


def eval_wide(scored: DataFrame, strategies: Sequence[str] = fixed.STRATEGIES) -> DataFrame:
    """One row per question from one row per question and strategy ``(conv_id, qa_idx, question, ground_truth,
    strategy, answer, score, n_tokens)``, for the strategies named, whatever they are.

    Only numbers are pivoted, summed up before the shuffle. Texts join them by key, each once: a strategy's answers from its own rows, the
    question from those of the first strategy. Questions without a row of that are looked for first, by their keys; theirs come from
    the first strategy they have. ``scored`` is read several times, so give this a written table."""
    key = ["conv_id", "qa_idx"]
    carried = [c for c in ("conversation_id", "question", "ground_truth") if c in scored.columns]
    nth = F.array_position(F.array(*[F.lit(s) for s in strategies]), F.col("strategy")) - 1
    rows = scored.withColumn("nth", nth.cast("int")).filter(F.col("nth") >= 0)

    def of(i: int, column: str) -> Column:
        return F.max(F.when(F.col("nth") == i, F.col(column)))

    wide = rows.groupBy(*key).agg(
        F.min("nth").alias("first_of"),
        *[of(i, column).alias(f"{s}_{name}") for name, column in _PIVOTED for i, s in enumerate(strategies)],
    )
    lacking = wide.filter(F.col("first_of") > 0).select(*key, F.col("first_of").alias("nth"))
    for i, s in enumerate(strategies):
        answers = rows.filter(F.col("nth") == i)
        wide = wide.join(answers.select(*key, *(carried if i == 0 else []), F.col("answer").alias(f"{s}_answer")), key, "left")
    if not lacking.isEmpty():
        others = rows.filter(F.col("nth") > 0).join(lacking, [*key, "nth"])
        others = others.select(*key, *[F.col(c).alias(f"other_{c}") for c in carried])
        wide = wide.join(others, key, "left").withColumns({c: F.coalesce(c, f"other_{c}") for c in carried})
    return with_derived(wide)


_PIVOTED = (("score", "score"), ("tokens", "n_tokens"))


def result_rows(wide: DataFrame, strategies: Sequence[str] = fixed.STRATEGIES) -> DataFrame:
    """The columns of a stored result, in order. Without another identity ``conv_id`` is the conversation's."""
    identity = "conversation_id" if "conversation_id" in wide.columns else "conv_id"
    fields = StructType.fromDDL(result_schema(strategies))
    return wide.withColumn("conversation_id", F.col(identity).cast("string")).select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]
    )


def method_summary(results: DataFrame, strategies: Sequence[str] = fixed.STRATEGIES) -> DataFrame:
    """``(method, avg_qa_score, avg_compression_ratio, n_samples)``, sorted by method; averages over questions.

    ``baseline`` and ``compressed`` are reported with the tail's ratio, any strategy of the user's with the share of the
    oracle's tokens that it keeps itself. One pass over the results: all averages are taken side by side and then turned
    into rows, so that no results still make a row of zeros for each strategy."""

    def kept(strategy: str) -> Column:
        if strategy == "oracle":
            return F.avg(F.when(F.col("oracle_score").isNotNull(), F.lit(1.0)))
        if strategy in fixed.STRATEGIES or "oracle_tokens" not in results.columns:
            return F.avg("compression_ratio")
        return F.avg(round_half_even(ratio(F.col(f"`{strategy}_tokens`"), F.col("oracle_tokens")), fixed.RATIO_DECIMALS))

    sums = results.agg(
        *[F.avg(f"`{s}_score`").alias(f"avg_{i}") for i, s in enumerate(strategies)],
        *[F.count(f"`{s}_score`").alias(f"n_{i}") for i, s in enumerate(strategies)],
        *[kept(s).alias(f"ratio_{i}") for i, s in enumerate(strategies)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("method"),
                F.coalesce(f"avg_{i}", F.lit(0.0)).alias("avg_qa_score"),
                F.coalesce(f"ratio_{i}", F.lit(0.0)).alias("avg_compression_ratio"),
                F.col(f"n_{i}").alias("n_samples"),
            )
            for i, s in enumerate(strategies)
        ]
    )
    return sums.select(F.inline(rows)).orderBy("method")


def flat_metrics(summary: DataFrame) -> DataFrame:
    """``(metric, value)`` rows named ``eval/<method>/<metric>``."""
    names = ("avg_qa_score", "avg_compression_ratio", "n_samples")
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])
    return summary.select("method", F.inline(values)).select(
        F.concat_ws("/", F.lit("eval"), "method", "name").alias("metric"), "value"
    )


def split_metrics(sizes: DataFrame) -> DataFrame:
    """``data/<split>_size`` rows; a split without conversations counts 0."""
    counts = sizes.agg(*[F.sum(F.when(F.col("split") == s, F.col("n"))).alias(s) for s in fixed.SPLITS])
    rows = F.array(
        *[
            F.struct(
                F.lit(f"data/{s}_size").alias("metric"),
                F.coalesce(F.col(s), F.lit(0)).cast("double").alias("value"),
            )
            for s in fixed.SPLITS
        ]
    )
    return counts.select(F.inline(rows))


def vocabulary_metric(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count("*").cast("double").alias("value")).select(
        F.lit("word2vec/vocab_size").alias("metric"), "value"
    )


def failure_metric(n: DataFrame) -> DataFrame:
    """``eval/failed_calls`` out of a table that counts them in ``n``."""
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value")).select(
        F.lit("eval/failed_calls").alias("metric"), "value"
    )


def eval_count(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n_results"))
