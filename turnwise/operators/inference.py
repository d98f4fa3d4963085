"""Calling a model from Spark tasks. The model itself is the user's."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import DataFrame

# Called once per task; returns a function from a request's messages to the model's reply. A reply that cannot be had
# is a ModelError. With ``batch_size``, the function gets a list of requests' messages and returns a list of replies, in which
# a ModelError stands for a reply that cannot be had.
MakeModel = Callable[[], Callable[[list[dict[str, str]]], str]]

RESPONSE_SCHEMA = "request_id string, attempt int, status string, raw_text string, error string"
OK = "ok"
API_ERROR = "api_error"
REPLY_ROWS = 64  # replies a task passes on at a time


class ModelError(Exception):
    """A model's function raises this when a call failed and may be tried again. Anything else ends the run."""


def batch_infer(
    requests: DataFrame,
    make_model: MakeModel,
    attempt: int = 1,
    concurrency: int | None = None,
    in_flight: int = 1,
    batch_size: int | None = None,
) -> DataFrame:
    """Send every request once and return a row for each, whether the call succeeded or failed with a ``ModelError``,
    whose text is kept as ``error``.

    A task keeps up to ``in_flight`` calls open and takes replies as they come; the model's function is then called from as many threads. With
    ``batch_size`` a call carries so many requests. No more requests than that are read ahead, so memory is bounded by the window. Rows
    come in no particular order.

    Calls are slow and not repeatable: write the result to a table before using it, and run the stage without
    speculation. ``concurrency`` bounds how many tasks call at a time; requests stay where they are."""
    if in_flight < 1 or (batch_size is not None and batch_size < 1):
        raise ValueError(f"at least one call of at least one request, got in_flight={in_flight}, batch_size={batch_size}")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies = _replies(_calls(batches, batch_size or 1), make_model(), in_flight, batch_size is not None)
        while rows := list(itertools.islice(replies, REPLY_ROWS)):
            columns = zip(*[(request_id, attempt, *reply) for request_id, reply in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = [field.split()[0] for field in RESPONSE_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    sent = requests.select("request_id", "messages")
    if concurrency is not None:
        sent = sent.coalesce(concurrency)
    return sent.mapInArrow(call, RESPONSE_SCHEMA)


def _calls(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[str, list]]]:
    """(id, messages) of requests, ``size`` of them at a time."""
    rows = (
        (batch["request_id"][i].as_py(), batch["messages"][i].as_py()) for batch in batches for i in range(batch.num_rows)
    )
    while some := list(itertools.islice(rows, size)):
        yield some


def _reply(reply: str | ModelError | None) -> tuple[str, str | None, str | None]:
    """(status, text, error)"""
    if isinstance(reply, ModelError):
        return API_ERROR, None, str(reply)
    return OK, reply, None


def _replies(calls: Iterator[list[tuple[str, list]]], model: Callable, in_flight: int, together: bool) -> Iterator[tuple]:
    """(id, (status, text, error)) of every request, with at most ``in_flight`` calls open. An exception that is no ``ModelError`` ends the
    task once the calls that are open have come back; no more are made."""

    def send(some: list[tuple[str, list]]) -> list[tuple]:
        try:
            said = model([messages for _, messages in some]) if together else [model(some[0][1])]
        except ModelError as missing:
            said = [missing] * len(some)
        if len(said) != len(some):
            raise ValueError(f"{len(said)} replies to {len(some)} requests")
        return [(request_id, _reply(reply)) for (request_id, _), reply in zip(some, said)]

    if in_flight == 1:
        for some in calls:
            yield from send(some)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        open_calls = {pool.submit(send, some) for some in itertools.islice(calls, in_flight)}
        while open_calls:
            done, open_calls = wait(open_calls, return_when=FIRST_COMPLETED)
            replies = [reply for call in done for reply in call.result()]
            open_calls |= {pool.submit(send, some) for some in itertools.islice(calls, in_flight - len(open_calls))}
            yield from replies
