"""From raw documents to token files: quality, near duplicates, benchmark passages, mixing, tokens.

Documents have ``doc_id`` (a whole number or null), ``text`` and ``source``; all other columns, whatever their names, are carried along. Every stage
takes null, empty and very long texts, null ids and repeated rows as they come, and gives no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import byte_cnn, decontaminate, mixing, ngram_join, token_files
from turnwise.llm.queries import END, quality_network, table, tokenizer_file
from turnwise.sources.scratch import land, scratch_path

QUALITY = 0.5  # documents that score lower go


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the byte-level network does not reject; it learns from the labels of the query's folds.

    Null and empty texts are scored as a text of no bytes, repeated rows alike. Without labels of both kinds every score is the share of
    good ones, a half if there are none at all, and then nothing is rejected."""
    scored = byte_cnn.score_quality(docs, quality_network(spark, sf_dir, docs))
    return scored.where(F.col("score") >= QUALITY).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the one with the least id, null ids last; one row of equal ones.

    Documents without words, null texts included, are linked to nothing and stay."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Documents and items without words are never hit nor hit anything; without items all stay."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where("n_hit = 0").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them, and the first words of those it takes a part of.

    A null source is one of its own. Documents without words are not in a mix of words. ``n_chars``, if there is one, is that of the text as it is now."""
    mixed = mixing.mixed_documents(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row for each document in them, as often as it is there. A null text has the end id alone."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, path, tokenizer_file(), END)
    return token_files.read_documents(spark, path)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixture),
    ("token files", tokens),
]

# SQL expresses neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), scratch_path(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
