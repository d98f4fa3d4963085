"""Request tables for the models: QA generation, answering, judging.

A request is ``(request_id, kind, conv_id, …, messages)`` with ``messages array<struct<role,content>>``. Ids are
hashes of what identifies a request, of the messages themselves and of the model's label: a rerun makes the same ones, and
a reply to another text, prompt or model is never taken for one to this. Prompts are joined with ``concat``: a text may hold
``%`` or braces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.operators.contexts import Strategy, contexts, transcript
from turnwise.operators.questions import complete_qa, explode_qa

QA_SYSTEM = "You write reading comprehension questions about chat conversations. Reply with one JSON object only."
ANSWER_SYSTEM = "A chat log and a question follow. Reply with the shortest phrase of the log that settles the question."
DEFAULT_SYSTEM = "A chat log and a question follow."
JUDGE_SYSTEM = 'Compare two answers to a question. Reply with one JSON object that has a numeric "score", nothing else.'
JUDGE_SCALE = (
    "Count the separate facts the reference answer states. The score is ten times the share of them that the given answer "
    "states too, less two for every fact in it that the reference contradicts, and never below zero."
)


def request_id(kind: str, *parts: Column, said: Column, model: str = "") -> Column:
    """``said`` are the request's messages, ``model`` is any label that tells models apart."""
    content = F.sha2(F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e"), 256)
    return F.sha2(F.concat_ws("|", F.lit(kind), F.lit(model), *[p.cast("string") for p in parts], content), 256)


def messages(system: Column, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def qa_requests(
    conversations: DataFrame,
    qa_per_conv: int = fixed.QA_PER_CONV,
    system: str = QA_SYSTEM,
    model: str = "",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One request per nested conversation for ``qa_per_conv`` questions with short answers."""
    user = F.concat(
        F.lit(f"Write {qa_per_conv} questions about facts in the conversation below, each with a short answer. "),
        F.lit('Reply as {"qa_pairs": [{"question": "...", "answer": "..."}]}.\n\n'),
        transcript(F.col("turns")),
    )
    sent = conversations.select("conv_id", *keep, messages(F.lit(system), user).alias("messages"))
    return sent.select(
        request_id("qa", F.col("conv_id"), said=F.col("messages"), model=model).alias("request_id"),
        F.lit("qa").alias("kind"),
        "conv_id",
        *keep,
        "messages",
    )


def answer_requests(
    conversations: DataFrame,
    strategies: Mapping[str, Strategy] | None = None,
    system: str = ANSWER_SYSTEM,
    model: str = "",
) -> DataFrame:
    """One request per complete pair and strategy, from nested conversations with ``qa_pairs``; no shuffle."""
    keep = [c for c in ("conversation_id", "qa_pairs") if c in conversations.columns]
    rows = complete_qa(explode_qa(contexts(conversations, strategies, keep=keep)))
    user = F.concat(
        F.lit(fixed.CONTEXT_HEAD), F.col("context"), F.lit(fixed.QUESTION_HEAD), F.col("question")
    )
    rows = rows.withColumn("messages", messages(F.lit(system or DEFAULT_SYSTEM), user))
    key = request_id("answer", F.col("conv_id"), F.col("qa_idx"), F.col("strategy"), said=F.col("messages"), model=model)
    return rows.select(
        key.alias("request_id"),
        F.lit("answer").alias("kind"),
        "conv_id",
        *[c for c in keep if c != "qa_pairs"],
        "qa_idx",
        "strategy",
        "question",
        "ground_truth",
        "n_tokens",
        "messages",
    )


def judge_requests(
    answers: DataFrame, system: str = JUDGE_SYSTEM, scale: str = JUDGE_SCALE, model: str = ""
) -> DataFrame:
    """One request per answered question and strategy to grade its ``answer`` against its ``ground_truth``; all other
    columns stay beside it. A call that failed has no answer, and is graded as an empty one."""
    user = F.concat(
        F.lit(f"{scale}\n\nQuestion: "),
        F.col("question"),
        F.lit("\nReference answer: "),
        F.col("ground_truth"),
        F.lit("\nGiven answer: "),
        F.coalesce("answer", F.lit("")),
    )
    others = [c for c in answers.columns if c not in ("request_id", "kind", "messages")]
    sent = answers.select(*others, messages(F.lit(system), user).alias("messages"))
    key = request_id("judge", F.col("conv_id"), F.col("qa_idx"), F.col("strategy"), said=F.col("messages"), model=model)
    return sent.select(key.alias("request_id"), F.lit("judge").alias("kind"), *others, "messages")
