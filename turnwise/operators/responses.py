"""Response tables ``(request_id, attempt, status, raw_text)`` and what they amount to.

Retries are rows. A request's outcome is its first successful attempt among ``max_retries``, or a default. The outcome
is a keyed minimum of numbers, which is combined before the shuffle; request ids are hashes, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.parsing import QA_PAIRS_TYPE, clamp_score, extract_score, qa_json, qa_pairs
from turnwise.operators.inference import API_ERROR, OK


def parse_qa(responses: DataFrame) -> DataFrame:
    """Add ``parse_ok`` and ``qa_pairs``. An object without pairs parses, with an empty list."""
    read = responses.withColumn("json", F.when(F.col("status") == OK, qa_json(F.col("raw_text"))))
    return read.select(
        *responses.columns,
        F.col("json").isNotNull().alias("parse_ok"),
        qa_pairs(F.col("json")).alias("qa_pairs"),
    )


def score_responses(responses: DataFrame) -> DataFrame:
    """Add the clamped ``score``; null for a failed call."""
    score = clamp_score(extract_score(F.col("raw_text")))
    return responses.withColumn("score", F.when(F.col("status") == OK, score))


def first_success(attempts: DataFrame, succeeded: Column, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """The first successful attempt of each request that has one, as it was given; a request's attempts have different
    numbers.

    Numbers alone are compared; replies meet the winning number afterwards, so none is sorted, and only winners are
    parsed for what they hold."""
    number = F.when((F.col("attempt") <= max_retries) & succeeded, F.col("attempt"))
    first = attempts.groupBy("request_id").agg(F.min(number).alias("attempt")).filter(F.col("attempt").isNotNull())
    return attempts.join(first, ["request_id", "attempt"])


def attach(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Put each request's outcome beside it; null where there is none."""
    return requests.join(outcomes, "request_id", "left")


def resolve_qa(requests: DataFrame, responses: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Add ``qa_pairs``. Failed calls and unreadable replies are both tried again; without success the list is
    empty."""
    parses = (F.col("status") == OK) & qa_json(F.col("raw_text")).isNotNull()
    replies = responses.select("request_id", "attempt", "status", "raw_text")
    found = parse_qa(first_success(replies, parses, max_retries)).select("request_id", "attempt", "qa_pairs")
    pairs = F.when(F.col("attempt").isNull(), F.array().cast(QA_PAIRS_TYPE)).otherwise(F.col("qa_pairs"))
    return attach(requests, found).withColumn("qa_pairs", pairs).drop("attempt")


def resolve_scores(requests: DataFrame, responses: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Add ``score``. Only failed calls are tried again: a reply without a score is a 0.0, and so is no reply."""
    replies = responses.select("request_id", "attempt", "status", "raw_text")
    found = score_responses(first_success(replies, F.col("status") == OK, max_retries)).select("request_id", "score")
    return attach(requests, found).withColumn("score", F.coalesce("score", F.lit(0.0)))


def resolve_answers(requests: DataFrame, responses: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Add ``answer``, the text of the first call that succeeded; null without one."""
    replies = responses.select("request_id", "attempt", "status", "raw_text")
    found = first_success(replies, F.col("status") == OK, max_retries)
    return attach(requests, found.select("request_id", F.col("raw_text").alias("answer")))


def failed_calls(responses: DataFrame) -> DataFrame:
    """One row: how many calls failed, whether they were tried again or not."""
    return responses.agg(F.count_if(F.col("status") == API_ERROR).alias("n"))


def unresolved(requests: DataFrame, responses: DataFrame, succeeded: Column) -> DataFrame:
    """Ids of requests without a successful attempt yet; what a next round or a rerun still has to send. Only ids meet."""
    return requests.select("request_id").join(
        responses.filter(succeeded).select("request_id"), "request_id", "left_anti"
    )
