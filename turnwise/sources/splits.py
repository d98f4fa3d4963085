"""Split tables: one folder per split under a root."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.functions.parsing import QA_PAIRS_TYPE
from turnwise.operators.turns import TURNS_TYPE
from turnwise.sources.buckets import default_buckets, open_buckets, write_buckets

logger = logging.getLogger(__name__)


def write_splits(conversations: DataFrame, root: str, fmt: str = "parquet") -> None:
    """Write conversations that carry a ``split`` column, replacing what was there. ``fmt`` may be ``json``: one
    object per line, text unescaped."""
    conversations.write.mode("overwrite").partitionBy("split").format(fmt).save(root)


def write_bucketed_splits(conversations: DataFrame, root: str) -> None:
    """``write_splits`` in buckets of ``conv_id``: what is joined to conversations later moves to them, not they to it. Any reader
    of split folders reads these too."""
    write_buckets(conversations, root, "conv_id", default_buckets(conversations.sparkSession, len(fixed.SPLITS)), "split")


def read_bucketed_split(spark: SparkSession, root: str, split: str = "both") -> DataFrame:
    wanted = ["val", "test"] if split == "both" else [split]
    return open_buckets(spark, root).filter(F.col("split").isin(*wanted))


def read_split(spark: SparkSession, root: str, split: str = "both", schema: str | None = None) -> DataFrame:
    """``val``, ``test`` or ``both``; other folders are pruned."""
    wanted = ["val", "test"] if split == "both" else [split]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(root).filter(F.col("split").isin(*wanted))


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("conv_id string").parquet(path)  # with a schema given, no file is opened
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_splits(spark: SparkSession, root: str, splits: Sequence[str] = fixed.SPLITS) -> DataFrame:
    """All conversations of the splits that are there, as one bag; a missing one is skipped with a warning."""
    paths = [f"{root}/split={s}" for s in splits]
    found = [p for p in paths if _exists(spark, p)]
    for path in paths:
        if path not in found:
            logger.warning("split not found, skipping: %s", path)
    if not found:
        raise FileNotFoundError(f"no split under {root}")
    return spark.read.option("basePath", root).parquet(*found)


EVAL_SCHEMA = f"conv_id string, conversation_id string, turns {TURNS_TYPE}, shuffle_key string, qa_pairs {QA_PAIRS_TYPE}"


def read_eval_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Conversations with ``qa_pairs``; none if nothing was written there, in which case there is nothing to
    evaluate."""
    if not _exists(spark, path):
        logger.warning("no QA pairs at %s, skipping the evaluation", path)
        return spark.createDataFrame([], EVAL_SCHEMA)
    return spark.read.parquet(path)
