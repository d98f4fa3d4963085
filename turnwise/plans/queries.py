"""The registered queries: one per step of an evaluation, over the whole given tables.

Each takes ``(spark, sf_dir)``. Nested values are written out as text or rows, so that results compare as plain
columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import fixed, parsing, text
from turnwise.functions.numbers import l2_norm
from turnwise.operators import (
    contexts,
    evaluation,
    inference,
    questions,
    requests,
    responses,
    splits,
    turns,
    vectors,
)
from turnwise.plans import evaluation as plan
from turnwise.plans import inputs
from turnwise.settings import Settings
from turnwise.sources import conversations as sources
from turnwise.sources.buckets import write_buckets
from turnwise.sources import splits as split_tables
from turnwise.sources import tables
from turnwise.sources import vectors as vector_files
from turnwise.sources.scratch import land, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
QUESTION = ("conv_id", "qa_idx", "strategy")


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _turns_text(column: str = "turns") -> Column:
    return F.array_join(F.transform(column, lambda t: F.concat_ws("|", t["turn"], t["role"], t["text"])), "\n")


def _n_pairs() -> Column:
    return F.size("qa_pairs").alias("n_pairs")


def _sent(df: DataFrame, *columns: str) -> DataFrame:
    """Requests with the two messages as columns."""
    content = F.col("messages.content")
    return df.select(
        "request_id", *columns, F.get(content, 0).alias("system_text"), F.get(content, 1).alias("user_text")
    )


# ---- sources and sinks


@query
def scan_conversations(spark, sf_dir):
    return sources.read_turns(spark, f"{sf_dir}/conversations.parquet")


@query
def scan_fallback(spark, sf_dir):
    view = f"turnwise_raw_{uuid.uuid4().hex}"
    inputs.raw_conversations(spark, sf_dir).createTempView(view)
    kept = turns.at_least(turns.clean_turns(sources.nested(sources.read_source(spark, table=view))), inputs.MIN_TURNS)
    return kept.select("conversation_id", F.size("turns").alias("n_turns"))


@query
def flat_to_nested(spark, sf_dir):
    flat = turns.require_nestable(sources.read_turns(spark, f"{sf_dir}/conversations.parquet"))
    nested = turns.nest_turns(flat)
    return nested.select("conv_id", F.size("turns").alias("n_turns"), _turns_text().alias("turns_text"))


@query
def conversation_bytes(spark, sf_dir):
    """Conversations by size, as the guard of nesting sums them; a third of them or so is over the limit here."""
    return turns.too_long(sources.read_turns(spark, f"{sf_dir}/conversations.parquet"), 1500)


@query
def nested_to_flat(spark, sf_dir):
    nested = turns.nest_turns(sources.read_turns(spark, f"{sf_dir}/conversations.parquet"))
    return turns.flatten_turns(nested)


@query
def write_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split_tables.write_splits(inputs.split_conversations(spark, sf_dir), path)
    return (
        spark.read.parquet(path)
        .groupBy("split")
        .agg(F.count("*").alias("n"), F.sum(F.size("turns")).alias("n_turns"))
    )


@query
def read_splits_tolerant(spark, sf_dir):
    path = scratch_path(spark, "splits")
    assigned = inputs.split_conversations(spark, sf_dir)
    split_tables.write_splits(assigned.filter(F.col("split") != "val"), path)
    return splits.split_sizes(split_tables.read_splits(spark, path))


@query
def read_split_for_qa(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split_tables.write_splits(inputs.split_conversations(spark, sf_dir), path)
    return split_tables.read_split(spark, path, "both").select("conv_id", "split", _turns_text().alias("turns_text"))


@query
def write_qa(spark, sf_dir):
    path = scratch_path(spark, "qa")
    tables.write_qa(inputs.enriched(spark, sf_dir), path)
    return spark.read.parquet(path).select("conv_id", "split", _n_pairs())


@query
def read_eval_dataset(spark, sf_dir):
    path = scratch_path(spark, "qa")
    inputs.enriched(spark, sf_dir).write.partitionBy("split").parquet(path)
    return split_tables.read_eval_dataset(spark, f"{path}/split=val").select("conv_id", _n_pairs())


@query
def write_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    tables.write_run(inputs.results(spark, sf_dir), path, "run-1")
    return tables.read_run(spark, path, "run-1").select(
        "run_id", "conversation_id", "qa_idx", *[f"{s}_score" for s in fixed.STRATEGIES], "compression_ratio"
    )


@query
def results_artifact(spark, sf_dir):
    """Two runs; the second is written again, which must not touch the first."""
    path = scratch_path(spark, "results")
    rows = land(inputs.results(spark, sf_dir), scratch_path(spark, "rows"))
    for run_id in ("run-1", "run-2", "run-2"):
        tables.write_run(rows, path, run_id)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n_results"))


@query
def metrics_sink(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    sizes = splits.split_sizes(splits.assign_splits(inputs.kept_ids(spark, sf_dir)))
    vocabulary = vectors.vocabulary(inputs.sentences(spark, sf_dir))
    summary = land(_summary(spark, sf_dir), scratch_path(spark, "summary"))
    for _ in range(2):  # a rerun of the run replaces its metrics
        tables.write_metrics(evaluation.split_metrics(sizes), path, "run-1")
        tables.write_metrics(evaluation.vocabulary_metric(vocabulary), path, "run-1")
        tables.write_metrics(evaluation.flat_metrics(summary), path, "run-1")
    return spark.read.parquet(path).select("run_id", "metric", "value")


def _trained(spark, sf_dir):
    return vectors.train_word2vec(inputs.sentences(spark, sf_dir))


@query
def save_word_vectors(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    vector_files.save_word_vectors(_trained(spark, sf_dir), path)
    return vector_files.load_word_vectors(spark, path).select("word", F.size("vector").alias("dim"))


@query
def load_word_vectors(spark, sf_dir):
    """The reloaded model's vectors beside the stored ones."""
    path = scratch_path(spark, "vectors")
    vector_files.save_word_vectors(_trained(spark, sf_dir), path)
    stored = vector_files.load_word_vectors(spark, path).withColumnRenamed("vector", "stored")
    again = vectors.word_vectors(vector_files.load_model(path))
    return stored.join(again, "word").select("word", (F.col("vector") == F.col("stored")).alias("same"))


# ---- projections, filters, predicates


@query
def valid_turns(spark, sf_dir):
    return turns.valid_turns(inputs.all_turns(spark, sf_dir))


@query
def clean_turns(spark, sf_dir):
    nested = turns.clean_turns(turns.nest_turns(inputs.all_turns(spark, sf_dir)))
    return nested.select("conv_id", F.size("turns").alias("n_turns"), _turns_text().alias("turns_text"))


@query
def min_turns_filter(spark, sf_dir):
    return inputs.kept_turns(spark, sf_dir)


@query
def project_conversation(spark, sf_dir):
    wide = inputs.conversations(spark, sf_dir).withColumn("source", F.lit("chat"))
    return turns.project(wide).select("conv_id", F.size("turns").alias("n_turns"), _turns_text().alias("turns_text"))


@query
def role_alias(spark, sf_dir):
    return inputs.all_turns(spark, sf_dir).select("conv_id", "turn", "role")


@query
def has_qa(spark, sf_dir):
    everything = inputs.with_qa(inputs.conversations(spark, sf_dir, min_turns=1))
    return questions.has_qa(everything).select("conv_id", _n_pairs())


@query
def complete_qa(spark, sf_dir):
    everything = inputs.with_qa(inputs.conversations(spark, sf_dir, min_turns=1))
    return questions.complete_qa(questions.explode_qa(everything)).select(
        "conv_id", "qa_idx", "question", "ground_truth"
    )


@query
def enrich_record(spark, sf_dir):
    """Conversations in buckets by id; the pairs move to them."""
    nested = inputs.conversations(spark, sf_dir).withColumn("qa_pairs", F.array().cast(parsing.QA_PAIRS_TYPE))
    stale = write_buckets(nested, scratch_path(spark, "stale"), "conv_id")
    return questions.enrich(stale, inputs.with_qa(stale)).select(
        "conv_id", F.size("turns").alias("n_turns"), _n_pairs()
    )


@query
def result_keys(spark, sf_dir):
    return inputs.results(spark, sf_dir).select("conversation_id", "qa_idx", "question", "ground_truth")


@query
def defaults(spark, sf_dir):
    """System turns stand in for turns that lack a role and a text."""
    flat = inputs.all_turns(spark, sf_dir)
    known = F.col("role") != "system"
    return turns.with_defaults(
        flat.withColumns({"role": F.when(known, F.col("role")), "text": F.when(known, F.col("text"))})
    )


# ---- joins and nested rows


@query
def explode_qa(spark, sf_dir):
    return questions.explode_qa(inputs.with_qa(inputs.conversations(spark, sf_dir))).select(
        "conv_id", "qa_idx", "question", "ground_truth"
    )


@query
def qa_by_strategy(spark, sf_dir):
    return inputs.answer_requests(spark, sf_dir).select(*QUESTION, "question", "ground_truth")


@query
def token_vector_lookup(spark, sf_dir):
    words = inputs.word_vectors(spark, sf_dir)
    return vectors.token_lookup(inputs.kept_turns(spark, sf_dir), words)


@query
def vocab_membership(spark, sf_dir):
    counts = vectors.word_counts(inputs.sentences(spark, sf_dir))
    words = inputs.word_vectors(spark, sf_dir)
    return vectors.with_known(counts, words)


@query
def attach_responses(spark, sf_dir):
    return inputs.answers(spark, sf_dir).select(*QUESTION, "request_id", "answer")


@query
def filtered_out(spark, sf_dir):
    return turns.discarded(inputs.all_turns(spark, sf_dir), inputs.MIN_TURNS)


# ---- aggregations


@query
def filter_counts(spark, sf_dir):
    return turns.filter_counts(inputs.all_turns(spark, sf_dir), inputs.MIN_TURNS)


@query
def split_sizes(spark, sf_dir):
    return splits.split_sizes(splits.assign_splits(inputs.kept_ids(spark, sf_dir)))


def _summary(spark, sf_dir):
    summary = evaluation.method_summary(inputs.results(spark, sf_dir))
    return summary.withColumn("avg_compression_ratio", F.round("avg_compression_ratio", 6)).withColumn(
        "avg_qa_score", F.round("avg_qa_score", 6)
    )


@query
def method_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query
def turn_embedding(spark, sf_dir):
    words = inputs.word_vectors(spark, sf_dir)
    embedded = vectors.turn_embeddings(inputs.kept_turns(spark, sf_dir), words, inputs.EMBEDDING_SIZE)
    return embedded.select(
        "conv_id", "turn", "n_known", F.posexplode("embedding").alias("dim", "value")
    ).withColumn("value", F.round(F.col("value").cast("double"), 4) + F.lit(0.0))


@query
def vocabulary(spark, sf_dir):
    return vectors.vocabulary(inputs.sentences(spark, sf_dir))


@query
def corpus_stats(spark, sf_dir):
    flat = turns.valid_turns(inputs.all_turns(spark, sf_dir))
    return vectors.corpus_stats(flat, splits.assign_splits(inputs.kept_ids(spark, sf_dir)))


@query
def transcript(spark, sf_dir):
    nested = turns.nest_turns(inputs.all_turns(spark, sf_dir))
    return nested.select("conv_id", contexts.transcript(F.col("turns")).alias("transcript"))


@query
def eval_rows(spark, sf_dir):
    return evaluation.eval_count(inputs.results(spark, sf_dir))


# ---- order, splits, attempts


@query
def split_assign(spark, sf_dir):
    return splits.assign_splits(inputs.kept_ids(spark, sf_dir)).select("conv_id", "split")


@query
def split_stable(spark, sf_dir):
    return splits.assign_stable_splits(inputs.kept_ids(spark, sf_dir)).select("conv_id", "split")


@query
def position(spark, sf_dir):
    return turns.with_position(inputs.kept_turns(spark, sf_dir)).select("conv_id", "position", "turn")


@query
def resolve_attempts(spark, sf_dir):
    return inputs.scored(spark, sf_dir).select(*QUESTION, "score")


@query
def resolve_qa_attempts(spark, sf_dir):
    sent = requests.qa_requests(inputs.conversations(spark, sf_dir)).select("request_id", "conv_id")
    resolved = responses.resolve_qa(sent, inputs.qa_responses(spark, sf_dir))
    return resolved.select("conv_id", _n_pairs())


@query
def sample_first_n(spark, sf_dir):
    return questions.sample_first(inputs.enriched(spark, sf_dir), 20).select("conv_id", "split", _n_pairs())


@query
def token_tail(spark, sf_dir):
    found = inputs.kept_turns(spark, sf_dir).withColumn("found", text.tokens(F.col("text")))
    return found.select("conv_id", "turn", text.tail_tokens(F.col("text"), 32, F.col("found")).alias("tail"))


@query
def sorted_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("method", "n_samples", "avg_qa_score")


@query
def seeded_shuffle(spark, sf_dir):
    return splits.seeded_order(inputs.kept_ids(spark, sf_dir))


@query
def preview(spark, sf_dir):
    rows = questions.explode_qa(inputs.with_qa(inputs.conversations(spark, sf_dir)))
    return rows.select("conv_id", "qa_idx", text.preview(F.col("question"), 60).alias("shown"))


# ---- set operations


@query
def union_splits(spark, sf_dir):
    path = scratch_path(spark, "splits")
    split_tables.write_splits(inputs.split_conversations(spark, sf_dir), path)
    corpus = split_tables.read_splits(spark, path)
    return corpus.select("conv_id", "split", F.inline("turns")).select("conv_id", "turn", "split", "text")


@query
def union_files(spark, sf_dir):
    """The table written as two JSON sources and read as one."""
    raw = inputs.raw_conversations(spark, sf_dir)
    path = scratch_path(spark, "json")
    first = splits.shuffle_key(F.col("id")) < "8"
    for name, part in (("first", raw.filter(first)), ("second", raw.filter(~first))):
        part.write.json(f"{path}/{name}")
    both = sources.read_source(spark, data_files=[f"{path}/first", f"{path}/second"], json_lines=True)
    return sources.nested(both).select("conversation_id", F.inline("turns"))


# ---- contexts, prompts, parsing, derived metrics


def _context(name: str) -> Query:
    def run(spark, sf_dir):
        strategies = {name: contexts.default_strategies()[name]}
        return contexts.contexts(inputs.conversations(spark, sf_dir), strategies).select("conv_id", "context")

    return run


QUERIES["ctx_oracle"] = _context("oracle")
QUERIES["ctx_compressed"] = _context("compressed")


@query
def ctx_baseline(spark, sf_dir):
    flat = turns.valid_turns(inputs.all_turns(spark, sf_dir))
    return contexts.tail_contexts(flat, min_turns=inputs.MIN_TURNS)


@query
def context_stats(spark, sf_dir):
    flat = turns.valid_turns(inputs.all_turns(spark, sf_dir))
    return contexts.default_token_counts(flat, min_turns=inputs.MIN_TURNS)


@query
def compression_ratio(spark, sf_dir):
    flat = turns.valid_turns(inputs.all_turns(spark, sf_dir))
    return contexts.with_compression_ratio(contexts.context_sizes(flat, min_turns=inputs.MIN_TURNS))


@query
def recovery_rate(spark, sf_dir):
    return inputs.results(spark, sf_dir).select(
        "conversation_id", "qa_idx", "oracle_score", "compressed_score", "recovery_rate"
    )


@query
def qa_requests(spark, sf_dir):
    return _sent(requests.qa_requests(inputs.conversations(spark, sf_dir)), "conv_id")


@query
def answer_requests(spark, sf_dir):
    return _sent(inputs.answer_requests(spark, sf_dir), *QUESTION)


@query
def judge_requests(spark, sf_dir):
    return _sent(requests.judge_requests(inputs.answers(spark, sf_dir)), *QUESTION)


@query
def parse_qa_response(spark, sf_dir):
    parsed = responses.parse_qa(inputs.qa_responses(spark, sf_dir))
    pairs = F.transform("qa_pairs", lambda p: F.concat_ws(" => ", p["question"], p["answer"]))
    return parsed.select("conv_id", "attempt", "parse_ok", F.array_join(pairs, "\n").alias("pairs_text"))


@query
def extract_score(spark, sf_dir):
    rows = inputs.judge_responses(inputs.answers(spark, sf_dir)).filter(F.col("status") == responses.OK)
    score = parsing.extract_score(F.col("raw_text"))
    return rows.select(*QUESTION, "attempt", "raw_text", score.alias("score"))


@query
def clamp_score(spark, sf_dir):
    rows = responses.score_responses(inputs.judge_responses(inputs.answers(spark, sf_dir)))
    return rows.select(*QUESTION, "attempt", "status", "score")


@query
def strip_prompt(spark, sf_dir):
    """The user message stands in for the prompt, and a reply with blanks around it follows."""
    asked = inputs.answer_requests(spark, sf_dir)
    prompt = F.get(F.col("messages.content"), 1)
    generated = F.concat(prompt, F.lit("\n \t"), F.col("ground_truth"), F.lit(" \n"))
    return asked.select(*QUESTION, parsing.strip_prompt(generated, prompt).alias("answer"))


@query
def eval_wide(spark, sf_dir):
    return inputs.results(spark, sf_dir)


@query
def custom_strategies(spark, sf_dir):
    """A strategy of the user's beside two of the usual ones, from contexts to the summary."""
    chosen = {k: v for k, v in contexts.default_strategies().items() if k != "compressed"}
    chosen["last_64"] = contexts.default_strategies(64)["baseline"]
    asked = requests.answer_requests(inputs.with_qa(inputs.conversations(spark, sf_dir)), chosen)
    rows = land(asked.drop("messages", "kind"), scratch_path(spark, "custom"))
    answered = responses.resolve_answers(rows, inputs.answer_responses(rows))
    score = F.length("answer") % 11
    scored = answered.withColumn("score", F.coalesce(score, F.lit(0)).cast("double"))
    names = list(chosen)
    wide = evaluation.eval_wide(land(scored, scratch_path(spark, "scored")), names)
    summary = evaluation.method_summary(evaluation.result_rows(wide, names), names)
    return summary.withColumn("avg_compression_ratio", F.round("avg_compression_ratio", 6)).withColumn(
        "avg_qa_score", F.round("avg_qa_score", 6)
    )


@query
def scan_json_arrays(spark, sf_dir):
    """The table as JSON arrays, one a file, read in ranges and re-cut into objects."""
    path = scratch_path(spark, "arrays")
    objects = inputs.raw_conversations(spark, sf_dir).select(F.to_json(F.struct("id", "conversations")).alias("value"))
    inputs.as_arrays(objects).write.text(path)
    nested = sources.nested(sources.read_raw(spark, [path], recut=scratch_path(spark, "recut")))
    return nested.select("conversation_id", F.size("turns").alias("n_turns"))


@query
def flat_metrics(spark, sf_dir):
    return evaluation.flat_metrics(_summary(spark, sf_dir))


# ---- vectors


@query
def sentences(spark, sf_dir):
    return inputs.sentences(spark, sf_dir).select(
        "conv_id", "turn", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens_text")
    )


@query
def train_word2vec(spark, sf_dir):
    """Every vector has a length, and all its values are finite."""
    norm = l2_norm(F.col("vector"))
    return vectors.word_vectors(_trained(spark, sf_dir)).select(
        "word", F.size("vector").alias("dim"), ((norm > 0) & (norm < 1e6)).alias("sane")
    )


@query
def embedding_norm(spark, sf_dir):
    words = inputs.word_vectors(spark, sf_dir)
    embedded = vectors.turn_embeddings(inputs.kept_turns(spark, sf_dir), words, inputs.EMBEDDING_SIZE)
    return embedded.select("conv_id", "turn", F.round(l2_norm(F.col("embedding")), 4).alias("norm"))


# ---- user code


@query
def batch_infer(spark, sf_dir):
    asked = inputs.answer_requests(spark, sf_dir)
    path = scratch_path(spark, "responses")
    tables.append_responses(inference.batch_infer(asked, inputs.stand_ins().answer, in_flight=4), path)
    return tables.read_responses(spark, path)


@query
def strategy_registry(spark, sf_dir):
    return contexts.contexts(inputs.conversations(spark, sf_dir), inputs.compressing(64))


@query
def evaluation_run(spark, sf_dir):
    settings = Settings(min_turns=inputs.MIN_TURNS)
    summary = plan.run(
        inputs.conversations(spark, sf_dir),
        scratch_path(spark, "run"),
        inputs.stand_ins(),
        "run-1",
        settings,
        ids=inputs.kept_ids(spark, sf_dir),
    )
    return summary.withColumn("avg_qa_score", F.round("avg_qa_score", 6)).withColumn(
        "avg_compression_ratio", F.round("avg_compression_ratio", 6)
    )
