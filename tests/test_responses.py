import pytest
from pyspark.sql import functions as F

from turnwise.operators import inference, questions, requests, responses
from turnwise.plans.evaluation import ask
from turnwise.sources import tables

GOOD = '{"qa_pairs":[{"question":"q","answer":"a"}]}'
RESPONSE = inference.RESPONSE_SCHEMA


def asked(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "request_id string")


def test_qa_attempts_are_repeated_after_failed_calls_and_unreadable_replies(spark):
    rows = [
        ("first", 1, "ok", GOOD),
        ("first", 2, "ok", '{"qa_pairs":[]}'),
        ("call", 1, "api_error", None),
        ("call", 2, "ok", GOOD),
        ("parse", 1, "ok", "nothing"),
        ("parse", 2, "ok", GOOD),
        ("empty", 1, "ok", '{"other":1}'),
        ("empty", 2, "ok", GOOD),
        ("null", 1, "ok", '{"qa_pairs":null}'),
        ("late", 1, "api_error", None),
        ("late", 2, "ok", "[1]"),
        ("late", 3, "ok", "{"),
        ("late", 4, "ok", GOOD),
    ]
    sent = asked(spark, "first", "call", "parse", "empty", "null", "late", "none")
    got = responses.resolve_qa(sent, spark.createDataFrame([(*r, None) for r in rows], RESPONSE)).collect()
    n = {r.request_id: None if r.qa_pairs is None else len(r.qa_pairs) for r in got}
    assert n == {"first": 1, "call": 1, "parse": 1, "empty": 0, "null": None, "late": 0, "none": 0}


def test_judge_attempts_are_repeated_after_failed_calls_only(spark):
    rows = [
        ("first", 1, "ok", "7"),
        ("first", 2, "ok", "3"),
        ("call", 1, "api_error", None),
        ("call", 2, "ok", "15 of 20, or 9"),
        ("parse", 1, "ok", "no grade"),
        ("parse", 2, "ok", "9"),
        ("late", 1, "api_error", None),
        ("late", 2, "api_error", None),
        ("late", 3, "api_error", None),
        ("late", 4, "ok", "9"),
        ("low", 1, "ok", '{"score": -4}'),
    ]
    sent = asked(spark, "first", "call", "parse", "late", "low", "none")
    got = responses.resolve_scores(sent, spark.createDataFrame([(*r, None) for r in rows], RESPONSE)).collect()
    scores = {r.request_id: r.score for r in got}
    assert scores == {"first": 7.0, "call": 0.0, "parse": 0.0, "late": 0.0, "low": 0.0, "none": 0.0}


def test_replies_are_not_sorted_to_find_the_first_success(spark):
    got = spark.createDataFrame([("a", 1, "ok", "x", None)], RESPONSE)
    plan = responses.resolve_scores(asked(spark, "a"), got)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def conversations(spark):
    return spark.sql(
        """SELECT * FROM VALUES
        (1L, 'b', array(named_struct('turn', 0L, 'role', 'human', 'text', 'a 100% {x}')),
         array(named_struct('question', 'q1', 'answer', 'a1'), named_struct('question', '', 'answer', 'a'),
               named_struct('question', ' ', 'answer', ' '), named_struct('question', 'q', 'answer', null))),
        (2L, 'a', array(named_struct('turn', 0L, 'role', 'gpt', 'text', 'b')), null),
        (3L, 'c', array(named_struct('turn', 0L, 'role', 'gpt', 'text', 'b')), array()),
        (4L, 'a', array(named_struct('turn', 0L, 'role', 'gpt', 'text', 'b')),
         array(named_struct('question', 'q', 'answer', 'a')))
        AS t(conv_id, shuffle_key, turns, qa_pairs)"""
    )


def test_sample_takes_conversations_with_pairs_in_order(spark):
    nested = conversations(spark)
    assert {r.conv_id for r in questions.has_qa(nested).collect()} == {1, 4}
    assert questions.sample_first(nested, 0).isEmpty()
    assert [r.conv_id for r in questions.sample_first(nested, 1).collect()] == [4]
    assert {r.conv_id for r in questions.sample_first(nested, 9).collect()} == {4, 1}


def test_incomplete_pairs_are_skipped_and_blank_ones_are_not(spark):
    rows = questions.complete_qa(questions.explode_qa(conversations(spark))).collect()
    assert sorted((r.conv_id, r.qa_idx, r.question) for r in rows) == [(1, 0, "q1"), (1, 2, " "), (4, 0, "q")]


def test_answer_requests_per_pair_and_strategy(spark):
    got = requests.answer_requests(conversations(spark).filter("conv_id = 1")).collect()
    assert len({r.request_id for r in got}) == len(got) == 6
    user = next(r for r in got if r.strategy == "oracle" and r.qa_idx == 0).messages[1]
    assert (user.role, user.content) == ("user", "Context:\nHuman: a 100% {x}\n\nQuestion: q1")
    other = requests.answer_requests(conversations(spark).filter("conv_id = 1"), system="").first()
    assert other.messages[0].content == requests.DEFAULT_SYSTEM


def test_a_rerun_sends_only_what_has_no_success(spark, tmp_path):
    """One request always fails, one fails to parse at first; calls are counted in files."""
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def make_model():
        import os
        import uuid

        from turnwise.operators.inference import ModelError

        def reply(messages):
            name = messages[0]["content"]
            tries = sum(f.startswith(name) for f in os.listdir(folder))
            open(f"{folder}/{name}-{uuid.uuid4().hex}", "w").close()
            if name == "broken":
                raise ModelError("no reply")
            return "nothing" if name == "slow" and tries == 0 else GOOD

        return reply

    names = spark.createDataFrame([("broken",), ("slow",), ("good",)], "request_id string")
    message = F.struct(F.lit("user").alias("role"), F.col("request_id").alias("content"))
    sent = names.withColumn("messages", F.array(message))

    def count():
        made = [f.name.split("-")[0] for f in calls.iterdir()]
        return {n: made.count(n) for n in ("broken", "slow", "good")}

    path = f"{tmp_path}/responses"
    for _ in range(2):  # the second run finds everything done
        got = ask(sent, path, make_model, responses.parse_qa, F.col("parse_ok"), 3, 2)
        assert count() == {"broken": 3, "slow": 2, "good": 1}
    pairs = {r.request_id: len(r.qa_pairs) for r in responses.resolve_qa(names, got).collect()}
    assert pairs == {"broken": 0, "slow": 1, "good": 1}
    failed = tables.read_responses(spark, path).filter("status = 'api_error'").collect()
    assert [r.error for r in failed] == ["no reply"] * 3


def test_a_programming_error_of_a_model_ends_the_run_and_keeps_earlier_chunks(spark, tmp_path):
    def make_model():
        def reply(messages):
            return {"good": "fine"}[messages[0]["content"]]

        return reply

    names = [f"r{i}" for i in range(40)]
    rows = spark.createDataFrame([(n, "good" if n != "r7" else "bad") for n in names], "request_id string, content string")
    sent = rows.select("request_id", F.array(F.struct(F.lit("user").alias("role"), "content")).alias("messages"))
    path = f"{tmp_path}/responses"
    with pytest.raises(Exception, match="KeyError"):
        ask(sent, path, make_model, lambda df: df, F.col("status") == "ok", 1, None, chunks=8)
    kept = {r.request_id for r in tables.read_responses(spark, path).collect()}
    assert "r7" not in kept and len(kept) < 40
    chunk = sent.select("request_id", F.pmod(F.xxhash64("request_id"), F.lit(8)).alias("c")).collect()
    failed = next(r.c for r in chunk if r.request_id == "r7")
    assert kept == {r.request_id for r in chunk if r.c < failed}


def test_pending_ids_are_found_without_messages(spark):
    sent = spark.createDataFrame([("a", "x")], "request_id string, messages string")
    got = spark.createDataFrame([("a", 1, "ok", "x", None)], RESPONSE)
    plan = responses.unresolved(sent, got, F.col("status") == "ok")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("messages") == 1 and "Project [request_id" in plan  # read, and left behind at once
    assert responses.unresolved(sent, got, F.col("status") == "ok").columns == ["request_id"]


def test_responses_that_are_not_there_yet_are_none(spark, tmp_path):
    assert tables.read_responses(spark, f"{tmp_path}/none").isEmpty()


@pytest.mark.parametrize("kind", ["qa", "judge"])
def test_request_ids_differ_by_kind(spark, kind):
    said = requests.messages(F.lit("s"), F.lit("u"))
    other = requests.messages(F.lit("s"), F.lit("v"))
    one = spark.range(1).select(
        requests.request_id(kind, F.col("id"), said=said),
        requests.request_id("answer", F.col("id"), said=said),
        requests.request_id(kind, F.col("id"), said=other),
        requests.request_id(kind, F.col("id"), said=said, model="other"),
    )
    assert len(set(one.first())) == 4
