"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in no fold."""
    return F.crc32(doc_id.cast("string")) % parts


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(``doc_id``, ``text``, ``label``) of at most ``rows`` labelled documents, half of either label as far as there are so many, and
    how many labelled ids there are of each label.

    ``learn`` says which labels may be used, as a condition on ``doc_id``. Null ids and labels are none; of several labels for an
    id the greatest counts. The ids with the least hashes are taken, so the sample depends on ids alone; a doc_id that
    several rows have is taken once, with its least text."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value in (0, 1):
        other = counts.get(1 - value, 0)
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(rows // 2, rows - other))
        picked = some if picked is None else picked.unionAll(some)
    # At most ``rows`` pairs of numbers.
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")), counts
