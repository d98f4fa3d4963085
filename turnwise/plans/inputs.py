"""What the registered queries start from: the given tables, and stand-ins derived from them by Spark.

The tables hold conversations but no models' replies. Questions, replies, grades and word vectors are derived from the
conversations by fixed rules. They exercise the code on every row; as grades they mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.parsing import QA_PAIRS_TYPE
from turnwise.operators import contexts, evaluation, requests, responses, splits, turns, vectors
from turnwise.plans.evaluation import Models
from turnwise.sources import conversations as sources
from turnwise.sources.scratch import land, scratch_path

ROLES = {"user": "human", "assistant": "gpt"}
MIN_TURNS = 4  # conversations of the given tables have eight turns at most
EMBEDDING_SIZE = 64


def all_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.map_roles(sources.read_turns(spark, f"{sf_dir}/conversations.parquet"), ROLES)


def kept_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.kept_turns(all_turns(spark, sf_dir), MIN_TURNS)


def kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.kept_ids(all_turns(spark, sf_dir), MIN_TURNS)


def conversations(spark: SparkSession, sf_dir: str, min_turns: int = MIN_TURNS) -> DataFrame:
    return turns.at_least(turns.nest_turns(turns.valid_turns(all_turns(spark, sf_dir))), min_turns)


def split_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(conversations(spark, sf_dir), kept_ids(spark, sf_dir))


def raw_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in the raw nested form ``(id, conversations)``."""
    nested = turns.nest_turns(all_turns(spark, sf_dir))
    pairs = F.transform("turns", lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value")))
    return nested.select(F.col("conv_id").cast("string").alias("id"), pairs.alias("conversations"))


def as_arrays(objects: DataFrame) -> DataFrame:
    """Lines of JSON arrays, one for each partition, out of ``value``, one JSON object a row."""

    def listed(batches):
        import pyarrow as pa

        mark = "["
        for batch in batches:
            lines = []
            for value in batch["value"].to_pylist():
                lines.append(mark + value)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if mark == "[" else "]"], pa.string())], ["value"])

    return objects.mapInArrow(listed, "value string")


def with_qa(nested: DataFrame) -> DataFrame:
    """Questions: all human turns. Answers: the turn right after, if it is a reply, else none."""
    following = F.transform(
        "turns",
        lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.get("turns", i + 1).alias("next")),
    )
    asked = F.filter(following, lambda t: t["role"] == "human")
    pairs = F.transform(
        asked,
        lambda t: F.struct(
            t["text"].alias("question"),
            F.when(t["next"]["role"] == "gpt", t["next"]["text"]).alias("answer"),
        ),
    )
    return nested.withColumn("qa_pairs", pairs.cast(QA_PAIRS_TYPE))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_qa(split_conversations(spark, sf_dir))


def answer_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.answer_requests(with_qa(conversations(spark, sf_dir)))


def attempts(df: DataFrame) -> DataFrame:
    """Three attempts of every request."""
    return df.withColumn("attempt", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))


def _choose(k: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (k + 1).cast("int"))


def qa_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to QA requests: the pairs as JSON, the same fenced, the same in prose, an object without pairs, one cut
    off, a failed call."""
    nested = with_qa(conversations(spark, sf_dir))
    json = F.to_json(F.struct("qa_pairs"))
    k = (F.col("conv_id") * 5 + F.col("attempt")) % 6
    raw = _choose(
        k,
        [
            json,
            F.concat(F.lit("```json\n"), json, F.lit("\n```")),
            F.concat(F.lit("Here they are: "), json, F.lit(" Anything else?")),
            F.lit('{"other": 1}'),
            F.substring(json, F.lit(1), F.length(json) - 3),
            F.lit(None).cast("string"),
        ],
    )
    return attempts(requests.qa_requests(nested, keep=["qa_pairs"]).drop("messages")).select(
        "request_id",
        "conv_id",
        "attempt",
        F.when(k == 5, responses.API_ERROR).otherwise(responses.OK).alias("status"),
        raw.alias("raw_text"),
    )


def answer_responses(asked: DataFrame) -> DataFrame:
    """Replies to answer requests: the expected answer under the full context, otherwise the question."""
    reply = F.when(F.col("strategy") == "oracle", F.col("ground_truth")).otherwise(
        F.concat_ws(": ", "strategy", "question")
    )
    return asked.select(
        "request_id", F.lit(1).alias("attempt"), F.lit(responses.OK).alias("status"), reply.alias("raw_text")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions, as a table that was written once: requests and replies both start from it."""
    asked = land(answer_requests(spark, sf_dir).drop("messages", "kind"), scratch_path(spark, "asked"))
    return responses.resolve_answers(asked, answer_responses(asked))


def judged(answers: DataFrame) -> DataFrame:
    """Answers with the id of the request that has them graded."""
    return requests.judge_requests(answers).drop("kind", "messages")


def judge_responses(answers: DataFrame) -> DataFrame:
    """Replies to judge requests: a score in many forms, none, or a failed call."""
    rows = attempts(judged(answers))
    number = F.array_position(F.array(*[F.lit(s) for s in fixed.STRATEGIES]), F.col("strategy")) - 1
    k = (F.col("conv_id") * 7 + F.col("qa_idx") * 3 + number + F.col("attempt")) % 8
    n = ((F.col("conv_id") + F.col("qa_idx") + number) % 11).cast("string")
    raw = _choose(
        k,
        [
            F.concat(F.lit('{"score": '), n, F.lit("}")),
            F.concat(F.lit('```json\n{"score": '), n, F.lit(".5}\n```")),
            F.concat(F.lit('{"score": "'), n, F.lit('"}')),
            F.concat(F.lit("Score: "), n, F.lit("/10")),
            F.concat(F.lit('{"score": 1'), n, F.lit("0}")),
            F.concat(F.lit('{"score": -'), n, F.lit("}")),
            F.lit("no grade"),
            F.lit(None).cast("string"),
        ],
    )
    return rows.select(
        "request_id",
        "conv_id",
        "qa_idx",
        "strategy",
        "attempt",
        F.when(k == 7, responses.API_ERROR).otherwise(responses.OK).alias("status"),
        raw.alias("raw_text"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers(spark, sf_dir)
    return responses.resolve_scores(judged(rows), judge_responses(rows))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = land(scored(spark, sf_dir), scratch_path(spark, "scored"))
    return evaluation.result_rows(evaluation.eval_wide(rows))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sentences(kept_turns(spark, sf_dir))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for about half of the vocabulary: a word's hash picks a row of ``embeddings``, or none."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.count("*")).scalar()
    slot = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % (rows * 2)
    words = vectors.vocabulary(sentences(spark, sf_dir)).select("word", slot.alias("vec_id"))
    found = words.join(table, "vec_id").select("word", F.col("embedding").cast("array<double>").alias("vector"))
    return land(found, scratch_path(spark, "vectors"))


def compressing(n: int) -> dict[str, Callable[[Column], Column]]:
    """The default strategies with another policy in the open slot: a tail of ``n`` tokens."""
    return contexts.default_strategies() | {"compressed": contexts.default_strategies(n)["baseline"]}


def stand_ins() -> Models:
    """Stand-ins for the three models. Nested functions travel to the workers by value."""

    def make_reader():
        import json

        def reply(messages):
            """Ask for the last line of the conversation, and answer with it."""
            last = messages[-1]["content"].rsplit("\n", 1)[-1]
            return json.dumps({"qa_pairs": [{"question": "What was said last?", "answer": last}]})

        return reply

    def make_counter():
        def reply(messages):
            """Count the tokens that were sent."""
            return f"{len(messages[-1]['content'].split())} tokens"

        return reply

    def make_grader():
        def reply(messages):
            """Grade by the length of the answer's line."""
            return '{"score": %d}' % (len(messages[-1]["content"].rsplit("\n", 1)[-1]) % 11)

        return reply

    return Models(qa=make_reader, answer=make_counter, judge=make_grader)
