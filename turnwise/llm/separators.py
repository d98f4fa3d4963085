"""Token counts by a separator scan over flat token files without an index.

A file is a run of blocks of raw ids (two or four bytes each, little-endian), cut at fixed lengths without regard to documents;
every document ends with the end-of-document id, which no text yields. Files are kept as Parquet rows (file, block, ids),
so that Spark commits them and any store will do. Next to the ids, but never read by the scan, stand the doc_ids in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.tokens import id_width, token_rows
from turnwise.sources.scratch import land, scratch_path

BLOCK_IDS = 1 << 18


def write_flat(docs: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Tokenizes every whole text (null: empty) and writes a file of blocks for each task."""
    width = id_width(tokenizer)
    rows = token_rows(docs, tokenizer, end, text, keep=[doc_id], plain_special=True)

    def run(batches):
        file, block = TaskContext.get().partitionId(), 0
        held, size, names = [], 0, []

        def made(ids, docs):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([docs], pa.list_(pa.int64()))],
                ["file", "block", "ids", "doc_ids"],
            )

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}")
                held.append(ids)
                names.append(doc)
                size += len(ids)
                if size >= BLOCK_IDS:
                    flat = np.concatenate(held)
                    while len(flat) >= BLOCK_IDS:
                        yield made(flat[:BLOCK_IDS], names)
                        flat, names, block = flat[BLOCK_IDS:], [], block + 1
                    held, size = [flat], len(flat)
        if size or names:
            yield made(np.concatenate(held), names)

    flat = rows.select(F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), "ids")
    flat.mapInArrow(run, "file int, block bigint, ids binary, doc_ids array<bigint>").write.option("compression", "zstd").parquet(path)


def scan(spark, path: str, end: int, width: int) -> DataFrame:
    """``file``, ``ordinal`` (of the document in its file, from 0), ``start`` (ids before it in the file) and ``n_tokens`` (without the
    end id), found in the ids alone.

    Each block is searched on its own: where separators stand, how many, and how many ids follow the last one. A prefix scan
    over these short rows, one a block, gives each block the ids and documents before it and the open ids a document brings
    in from earlier blocks; the first separator of a block closes that document. Ids after a file's last separator are
    no document. A file's blocks are summed in one task, a narrow row for each 2**18 ids."""
    blocks = spark.read.parquet(path).select("file", "block", "ids")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids = np.frombuffer(one.column("ids")[0].as_buffer(), f"<u{width}")
                at = np.flatnonzero(ids == end)
                open_ids = len(ids) - (at[-1] + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays(
                    [one.column("file"), one.column("block"), pa.array([len(ids)]), pa.array([int(open_ids)]), pa.array([at.tolist()], pa.list_(pa.int64()))],
                    ["file", "block", "n", "open", "at"],
                )

    found = land(blocks.mapInArrow(run, "file int, block bigint, n bigint, open bigint, at array<bigint>"), scratch_path(spark, "separators"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Where the document that is open at a block's start began: after the last separator of an earlier block.
    closed = F.when(F.size("at") > 0, F.col("upto") + F.col("n") - F.col("open"))
    carried = (
        found.select("file", "block", "n", "open", "at")
        .withColumn("upto", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("docs", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)))
        .withColumn("began", F.coalesce(F.last(closed, ignorenulls=True).over(before), F.lit(0)))
    )
    each = carried.select("file", "upto", "docs", "began", "at", F.posexplode("at").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("began")).otherwise(F.col("upto") + F.get("at", F.col("k") - 1) + 1)
    return each.select(
        "file", (F.col("docs") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("upto") + F.col("stop") - start).alias("n_tokens")
    )


def documents_in_order(spark, path: str) -> DataFrame:
    """``file``, ``ordinal`` and ``doc_id``: the order documents were written in."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.parquet(path).select("file", "block", "doc_ids")
    rows = rows.withColumn("docs", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    return rows.select("file", "docs", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("docs") + F.col("k")).alias("ordinal"), "doc_id")


def token_counts(docs: DataFrame, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``file``, ``start`` and ``n_tokens`` of every document: written flat, scanned, and joined by place.

    A null or empty text has 0 tokens; repeated rows are documents of their own; an empty table has none."""
    spark = docs.sparkSession
    path = scratch_path(spark, "flat")
    write_flat(docs, path, tokenizer, end, text, doc_id)
    found = scan(spark, path, end, id_width(tokenizer))
    return documents_in_order(spark, path).join(found, ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
