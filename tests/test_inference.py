"""Calls to models: a bounded window of open ones, batches, failures."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from turnwise.operators import inference
from turnwise.operators.inference import ModelError, batch_infer


def asked(spark, n, partitions=1):
    message = F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    rows = spark.range(0, n, 1, partitions)
    return rows.select(F.concat(F.lit("r"), F.col("id")).alias("request_id"), F.array(message).alias("messages"))


@pytest.fixture
def slow():
    def make():
        import time

        def reply(messages):
            time.sleep(0.05)
            return "to " + messages[0]["content"]

        return reply

    return make


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_open_calls_overlap_and_give_the_same(spark, slow):
    sent = asked(spark, 160)
    batch_infer(asked(spark, 8), slow).collect()  # start a worker
    times, results = [], []
    for in_flight in (1, 16):
        start = time.perf_counter()
        results.append(rows(batch_infer(sent, slow, in_flight=in_flight)))
        times.append(time.perf_counter() - start)
    assert results[0] == results[1] and len(results[0]) == 160
    assert times[0] > 8 and times[0] / times[1] >= 8


def test_no_more_calls_are_open_than_allowed():
    open_now, most, read = [0], [0], [0]
    lock = threading.Lock()

    def model(messages):
        with lock:
            open_now[0] += 1
            most[0] = max(most[0], open_now[0])
        time.sleep(0.002 * (messages % 5))
        with lock:
            open_now[0] -= 1
        return str(messages)

    def calls():
        for i in range(200):
            read[0] += 1
            yield [(f"r{i}", i)]

    got, ahead = [], []
    for reply in inference._replies(calls(), model, 7, False):
        got.append(reply)
        ahead.append(read[0] - len(got))
    assert sorted(got) == sorted((f"r{i}", ("ok", str(i), None)) for i in range(200))
    assert 1 < most[0] <= 7 and max(ahead) <= 14


@pytest.mark.parametrize("in_flight", [1, 5])
def test_failed_calls_are_rows_and_errors_end_the_run(spark, in_flight):
    def make():
        def reply(messages):
            if messages[0]["content"] == "3":
                raise ModelError("busy")
            return "fine"

        return reply

    got = {r.request_id: r for r in batch_infer(asked(spark, 10, 2), make, 2, in_flight=in_flight).collect()}
    assert len(got) == 10 and {r.attempt for r in got.values()} == {2}
    assert (got["r3"].status, got["r3"].raw_text, got["r3"].error) == ("api_error", None, "busy")
    assert {(r.status, r.raw_text, r.error) for k, r in got.items() if k != "r3"} == {("ok", "fine", None)}

    def broken():
        return lambda messages: {}[messages[0]["content"]]

    with pytest.raises(Exception, match="KeyError"):
        batch_infer(asked(spark, 10), broken, in_flight=in_flight).collect()


@pytest.mark.parametrize("in_flight", [1, 3])
def test_models_that_take_several_requests(spark, in_flight):
    def make():
        from turnwise.operators.inference import ModelError

        def replies(several):
            if any(m[0]["content"] == "20" for m in several):
                raise ModelError("all of them")
            return [ModelError("one") if m[0]["content"] == "2" else f"{len(several)}" for m in several]

        return replies

    got = {r.request_id: r for r in batch_infer(asked(spark, 23), make, in_flight=in_flight, batch_size=4).collect()}
    assert len(got) == 23 and got["r0"].raw_text == "4"
    assert (got["r2"].status, got["r2"].error) == ("api_error", "one")
    assert {got[f"r{i}"].error for i in (20, 21, 22)} == {"all of them"}

    def short():
        return lambda several: several[1:]

    with pytest.raises(Exception, match="replies to"):
        batch_infer(asked(spark, 9), short, batch_size=4).collect()


def test_windows_of_nothing_are_refused(spark, slow):
    for bad in ({"in_flight": 0}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            batch_infer(asked(spark, 1), slow, **bad)
    assert batch_infer(asked(spark, 0), slow, in_flight=4).collect() == []


def test_tasks_are_bounded_without_moving_requests(spark, slow):
    sent = batch_infer(asked(spark, 40, 8), slow, concurrency=2)
    assert sent.rdd.getNumPartitions() == 2
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
