"""An evaluation from conversations to metrics. Every stage writes a table and the next one starts from it, so a lost
executor repeats a stage at most, and a rerun sends no request that was answered before."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.operators import contexts, evaluation, inference, questions, requests, responses, splits, vectors
from turnwise.operators.turns import at_least, flatten_turns
from turnwise.settings import Settings
from turnwise.sources import splits as split_tables
from turnwise.sources import tables
from turnwise.sources.scratch import land
from turnwise.sources.vectors import save_word_vectors


@dataclass(frozen=True)
class Models:
    """The user's models; each is a factory, called once per task."""

    qa: inference.MakeModel
    answer: inference.MakeModel
    judge: inference.MakeModel
    concurrency: int | None = None  # tasks that call at a time
    in_flight: int = 1  # calls a task has open at a time
    label: str = ""  # tells these models from others, whose replies must not be taken for theirs


def prepare(conversations: DataFrame, root: str, settings: Settings, ids: DataFrame | None = None) -> DataFrame:
    """Split clean conversations, write the splits, and return their sizes."""
    assigned = splits.assign_splits(
        conversations, ids, settings.train_ratio, settings.val_ratio, settings.seed
    )
    split_tables.write_bucketed_splits(assigned, f"{root}/splits")
    spark = conversations.sparkSession
    return splits.split_sizes(spark.read.parquet(f"{root}/splits").select("split"))


def train(spark: SparkSession, root: str, settings: Settings) -> DataFrame:
    """Train and save word vectors on all splits, and return the vocabulary's size as a metric."""
    corpus = split_tables.read_splits(spark, f"{root}/splits")
    sentences = vectors.sentences(flatten_turns(corpus))
    model = vectors.train_word2vec(
        sentences,
        settings.vector_size,
        settings.window,
        settings.min_count,
        settings.epochs,
        settings.train_partitions,
        settings.seed,
    )
    save_word_vectors(model, f"{root}/vectors")
    return evaluation.vocabulary_metric(spark.read.parquet(f"{root}/vectors/vectors"))


def ask(
    sent: DataFrame,
    path: str,
    make_model: inference.MakeModel,
    done: Callable[[DataFrame], DataFrame],
    succeeded: Column,
    max_retries: int,
    concurrency: int | None,
    chunks: int = tables.CHUNKS,
    in_flight: int = 1,
) -> DataFrame:
    """Send requests until each has a successful attempt or has had ``max_retries``, appending every attempt to the
    response table. ``done`` adds to responses what ``succeeded`` needs. Returns the responses.

    ``sent`` is a table of ``write_requests`` of as many ``chunks``, or is made one. Chunks are sent one after the other, and each one's replies are
    appended before the next is sent: what was answered stays answered if the run ends. What is pending is found on ids alone. Prompts
    are not moved: a chunk of which all is pending is sent as it lies, of any other the ids move to the prompts' buckets."""
    spark = sent.sparkSession
    if "chunk" not in sent.columns:
        sent = tables.write_requests(sent.select("request_id", "messages"), f"{path}_requests", chunks)
    sizes = dict(sent.groupBy("chunk").agg(F.count("*")).collect())  # as many rows as chunks
    for attempt in range(1, max_retries + 1):
        so_far = done(tables.read_responses(spark, path))
        tried = F.col("attempt") >= attempt
        ids = responses.unresolved(sent, so_far, succeeded | tried).withColumn("chunk", tables.chunk_of(chunks))
        ids = land(ids, f"{path}_pending")
        left = dict(ids.groupBy("chunk").agg(F.count("*")).collect())
        for number in sorted(left):
            pending = pending_requests(sent, ids, number, left[number] == sizes[number])
            tables.append_responses(inference.batch_infer(pending, make_model, attempt, concurrency, in_flight), path)
    return tables.read_responses(spark, path)


def pending_requests(sent: DataFrame, ids: DataFrame, chunk: int, all_of_it: bool) -> DataFrame:
    """The requests of a chunk that ``ids`` names."""
    mine = sent.filter(F.col("chunk") == chunk).select("request_id", "messages")
    if all_of_it:
        return mine
    return mine.join(ids.filter(F.col("chunk") == chunk).select("request_id"), "request_id", "left_semi")


def generate_qa(spark: SparkSession, root: str, models: Models, settings: Settings, split: str = "both") -> DataFrame:
    """Have QA pairs written for the conversations of a split and write the enriched conversations, in place of those that split had.
    Returns the responses. Conversations stay in their buckets; the pairs move to them."""
    conversations = split_tables.read_bucketed_split(spark, f"{root}/splits", split)
    sent = requests.qa_requests(conversations, settings.qa_per_conv, model=models.label)
    sent = tables.write_requests(sent, f"{root}/responses/qa_requests")
    got = ask(
        sent,
        f"{root}/responses/qa",
        models.qa,
        responses.parse_qa,
        F.col("parse_ok"),
        settings.max_retries,
        models.concurrency,
        in_flight=models.in_flight,
    )
    resolved = responses.resolve_qa(sent.select("request_id", "conv_id"), got, settings.max_retries)
    enriched = questions.enrich(conversations, resolved).write.mode("overwrite").partitionBy("split")
    enriched.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/qa")
    return got


def evaluate(
    spark: SparkSession,
    root: str,
    models: Models,
    settings: Settings,
    run_id: str,
    strategies: Mapping[str, contexts.Strategy] | None = None,
    dataset: str | None = None,
    split: str = "val",
) -> DataFrame:
    """Evaluate the first ``n_samples`` conversations of a dataset under any strategies and write the result rows.

    ``dataset`` is a path of conversations with ``qa_pairs``, by default those generated for ``split``. Without QA
    pairs there are no results."""
    strategies = contexts.default_strategies(settings.truncation_tokens) if strategies is None else strategies
    enriched = split_tables.read_eval_dataset(spark, dataset or f"{root}/qa/split={split}")
    if enriched.isEmpty():
        return spark.createDataFrame([], evaluation.result_schema(list(strategies)))
    base = f"{root}/evaluations/{run_id}"
    sample = questions.sample_first(enriched, settings.n_samples)
    asked = requests.answer_requests(sample, strategies, model=models.label)
    sent = tables.write_requests(asked, f"{base}/answer_requests")
    is_ok = F.col("status") == responses.OK
    calls = {"concurrency": models.concurrency, "in_flight": models.in_flight}
    got = ask(sent, f"{base}/answers", models.answer, _as_is, is_ok, 1, **calls)
    answers = responses.resolve_answers(sent.drop("kind", "messages", "chunk"), got)
    answers = land(answers.drop("request_id"), f"{base}/answered")
    judged = tables.write_requests(requests.judge_requests(answers, model=models.label), f"{base}/judge_requests")
    verdicts = ask(judged, f"{base}/verdicts", models.judge, _as_is, is_ok, settings.max_retries, **calls)
    scored = responses.resolve_scores(judged.drop("kind", "messages", "chunk"), verdicts, settings.max_retries)
    names = list(strategies)
    results = evaluation.result_rows(evaluation.eval_wide(land(scored, f"{base}/scored"), names), names)
    path = f"{root}/results" if names == list(fixed.STRATEGIES) else f"{base}/results"
    tables.write_run(results, path, run_id)
    return tables.read_run(spark, path, run_id)


def failed_calls(spark: SparkSession, root: str, run_id: str, asked: list[DataFrame]) -> DataFrame:
    """How many calls failed among ``asked`` and the run's answers and verdicts, in one row for each."""
    base = f"{root}/evaluations/{run_id}"
    counts = [responses.failed_calls(r) for r in asked]
    counts += [responses.failed_calls(tables.read_responses(spark, f"{base}/{name}")) for name in ("answers", "verdicts")]
    return functools.reduce(DataFrame.unionAll, counts)


def _as_is(df: DataFrame) -> DataFrame:
    return df


def run(
    conversations: DataFrame,
    root: str,
    models: Models,
    run_id: str,
    settings: Settings | None = None,
    ids: DataFrame | None = None,
    with_qa: bool = True,
    strategies: Mapping[str, contexts.Strategy] | None = None,
    split: str = "val",
    dataset: str | None = None,
) -> DataFrame:
    """The whole evaluation of clean nested conversations of ``min_turns`` turns or more, under any strategies. Writes
    everything under ``root``, the run's metrics to ``<root>/metrics`` in place of those it had, and returns the summary.

    ``split`` (``val`` or ``test``) is the one that gets questions and is evaluated. ``dataset`` is a path of conversations that have
    questions already; they are evaluated instead, and no questions are generated."""
    settings = settings or Settings()
    spark = conversations.sparkSession
    conversations = at_least(conversations, settings.min_turns)
    metrics = f"{root}/metrics"
    sizes = prepare(conversations, root, settings, ids)
    tables.write_metrics(evaluation.split_metrics(sizes), metrics, run_id)
    tables.write_metrics(train(spark, root, settings), metrics, run_id)
    asked = [generate_qa(spark, root, models, settings, split)] if with_qa and dataset is None else []
    results = evaluate(spark, root, models, settings, run_id, strategies, dataset, split)
    summary = evaluation.method_summary(results, list(strategies or fixed.STRATEGIES))
    failed = evaluation.failure_metric(failed_calls(spark, root, run_id, asked))
    tables.write_metrics(evaluation.flat_metrics(summary).unionByName(failed), metrics, run_id)
    return summary
