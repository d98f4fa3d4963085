"""Question/answer pairs on nested conversations (``qa_pairs array<struct<question,answer>>``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.parsing import QA_PAIRS_TYPE


def enrich(conversations: DataFrame, qa: DataFrame) -> DataFrame:
    """Add ``qa_pairs`` from ``(conv_id, qa_pairs)``, or replace it; everything else stays."""
    return conversations.drop("qa_pairs").join(qa.select("conv_id", "qa_pairs"), "conv_id", "left")


def has_qa(conversations: DataFrame) -> DataFrame:
    """Conversations with at least one pair; missing, null and empty lists are dropped."""
    return conversations.filter(F.size(F.coalesce("qa_pairs", F.array().cast(QA_PAIRS_TYPE))) > 0)


def sample_first(conversations: DataFrame, n_samples: int = fixed.N_SAMPLES) -> DataFrame:
    """The first ``n_samples`` conversations with pairs, in the seeded order.

    Only keys are sorted, to find the last one that is taken; the conversations are compared with it where they are."""
    having = has_qa(conversations)
    first = having.select("shuffle_key", "conv_id").orderBy("shuffle_key", "conv_id").limit(n_samples)
    key = F.struct("shuffle_key", "conv_id")
    return having.filter(key <= first.agg(F.max(key)).scalar())


def explode_qa(conversations: DataFrame) -> DataFrame:
    """One row per pair, with its position ``qa_idx``, its ``question`` and its ``ground_truth``."""
    others = [c for c in conversations.columns if c != "qa_pairs"]
    return conversations.select(*others, F.posexplode("qa_pairs").alias("qa_idx", "qa")).select(
        *others,
        "qa_idx",
        F.coalesce("qa.question", F.lit("")).alias("question"),
        F.coalesce("qa.answer", F.lit("")).alias("ground_truth"),
    )


def complete_qa(qa: DataFrame) -> DataFrame:
    """Pairs that have both a question and an answer. Blank ones count as given."""
    return qa.filter((F.col("question") != "") & (F.col("ground_truth") != ""))
