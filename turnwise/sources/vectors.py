"""Word vectors at rest: the model, and its vectors as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.operators.vectors import WordVectors, word_vectors


def save_word_vectors(model: WordVectors, path: str) -> None:
    """Write the model to ``<path>/model`` and ``(word, vector)`` to ``<path>/vectors``."""
    model.table.write.mode("overwrite").parquet(f"{path}/model")
    word_vectors(model).write.mode("overwrite").parquet(f"{path}/vectors")


def load_model(path: str) -> WordVectors:
    return WordVectors(SparkSession.active().read.parquet(f"{path}/model"))


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")
