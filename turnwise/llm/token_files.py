"""Token-ID files: ids of documents in ascending doc_id order, rANS-coded in independent blocks with a shared table.

The files are Parquet, so that Spark commits them task by task and any store will do. A row is a block:

    part, block     place in the order: parts follow doc_id, blocks their part
    first           ids of the part before this block
    n               ids in the block
    ordinal, left   the document (by number in its part) that a previous block began, and how many of its ids are still to come
    doc_ids, sizes  documents that begin in this block, in order, and their numbers of ids
    payload         the block (see rans.py)

``table/`` beside them holds the shared frequencies, one row an id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.rans import BLOCK, Table, decode_blocks, encode_blocks, join_crc
from turnwise.llm.tokens import id_width, token_rows
from turnwise.sources.scratch import land, scratch_path

PART_IDS = 4_000_000  # ids a part is meant to hold, while there are no more than MOST_PARTS
MOST_PARTS = 16_384  # parts at most, however many ids there are
FILE_BLOCKS = 16_384  # blocks of a file at most; a part may write several
GROUP = 64  # blocks coded at once

BLOCK_SCHEMA = (
    "part int, block bigint, first bigint, n bigint, ordinal bigint, left bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary"
)


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """How often each id occurs in all documents."""

    def run(batches):
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            raw = batch.column(0)
            for value in raw:
                got = np.bincount(np.frombuffer(value.as_buffer(), f"<u{width}"))
                if len(got) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(got) - len(counts), np.int64)])
                counts[: len(got)] += got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _blocks_of(table, width):
    def run(batches):
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs: list[tuple] = []  # documents that begin in the ids held: (doc_id, size, place in what is held)
        state = {"n": 0, "first": 0, "block": 0, "ordinal": -1, "left": 0}

        def write(last):
            if not state["n"]:
                return None
            ids = np.concatenate(held)
            cut = len(ids) if last else len(ids) // BLOCK * BLOCK
            rows = []
            waiting = 0
            for k, payload in enumerate(encode_blocks(ids[:cut], table.value)):
                n = min(BLOCK, cut - k * BLOCK)
                begun = []
                while waiting < len(docs) and docs[waiting][2] < k * BLOCK + n:
                    begun.append(docs[waiting])
                    waiting += 1
                rows.append(
                    (part, state["block"], state["first"], n, state["ordinal"], state["left"], [d[0] for d in begun], [d[1] for d in begun], payload)
                )
                state["block"] += 1
                state["first"] += n
                if begun:
                    state["ordinal"] += len(begun)
                    state["left"] = begun[-1][2] + begun[-1][1] - (k * BLOCK + n)
                else:
                    state["left"] -= n
            rest = ids[cut:]
            held[:] = [rest] if len(rest) else []
            state["n"] = len(rest)
            docs[:] = [(d[0], d[1], d[2] - cut) for d in docs[waiting:]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
        many = pa.list_(pa.int64())
        types = [pa.int32(), *[pa.int64()] * 5, many, many, pa.binary()]
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(value.as_buffer(), f"<u{width}")
                docs.append((doc_id, len(ids), state["n"]))
                held.append(ids)
                state["n"] += len(ids)
                if state["n"] >= GROUP * BLOCK:
                    yield write(False)
        rows = write(True)
        if rows is not None:
            yield rows

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id", most_parts: int = MOST_PARTS
) -> None:
    """Encodes every whole text (null: empty) and writes the files under ``path``.

    Texts are tokenized where they are read, and the ids landed; counts over all of them make the shared table (as many rows
    as the vocabulary has ids). The ids are then dealt into ranges of doc_id, sorted and coded in one pass: ``most_parts`` ranges at
    most, so that a shuffle of many terabytes has a bounded table of its outputs. A larger range is sorted on disk, coded as a stream,
    and writes several files. Null doc_ids come first; rows of one doc_id follow the hash of their text, and equal rows are dealt over several
    ranges if there are many. doc_id is cast to a whole number: an id that is none is an error. An empty table gives no blocks."""
    spark = docs.sparkSession
    width = id_width(tokenizer)
    rows = token_rows(docs, tokenizer, end, text, keep=[doc_id]).select(F.col(f"row.`{doc_id}`").cast("long").alias("doc_id"), "tie", "n", "ids")
    scratch = scratch_path(spark, "ids")
    rows.write.option("compression", "zstd").parquet(scratch)
    tokens = spark.read.parquet(scratch)
    counts = id_counts(tokens, width).collect()  # one row for each id of the vocabulary
    total = sum(r.n for r in counts)
    dense = np.zeros(max([r.id for r in counts], default=0) + 1, np.int64)
    for r in counts:
        dense[r.id] = r.n
    table = Table.of_counts(dense)
    freq = [(int(i), int(f)) for i, f in enumerate(table.freq) if f]
    spark.createDataFrame(freq, "id bigint, freq bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table)
    parts = min(most_parts, max(1, math.ceil(total / PART_IDS)))
    dealt = tokens.withColumn("salt", F.monotonically_increasing_id())
    order = ["doc_id", "tie", "salt"]
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks = dealt.mapInArrow(_blocks_of(shared, width), BLOCK_SCHEMA)
    blocks.write.option("compression", "none").option("maxRecordsPerFile", FILE_BLOCKS).parquet(f"{path}/blocks")


def read_table(spark, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").collect()  # at most the vocabulary
    freq = np.zeros(max(r.id for r in rows) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return Table(freq)


def _decoded(batches, table):
    """Blocks of a batch with their ids, a group at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, GROUP):
            part = batch.slice(lo, GROUP)
            yield part, decode_blocks(part.column("payload").to_pylist(), table)


def read_documents(spark, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``, all from the files.

    Blocks decode on their own, in any task. A document that several blocks hold is put together from its pieces' lengths and
    checksums, never from its ids."""
    import zlib

    shared = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    piece = "part int, ordinal bigint, block bigint, doc_id bigint, begins boolean, start bigint, n bigint, crc bigint"
    names = [f.split()[0] for f in piece.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for group, decoded in _decoded(batches, shared.value):
            rows = []
            for row, ids in zip(group.drop_columns(["payload"]).to_pylist(), decoded):
                raw = ids.astype("<u4").tobytes()
                at = min(row["left"], len(ids))
                if at:
                    rows.append((row["part"], row["ordinal"], row["block"], None, False, None, at, zlib.crc32(raw[: 4 * at])))
                for k, (doc, size) in enumerate(zip(row["doc_ids"], row["sizes"])):
                    n = min(size, len(ids) - at)
                    rows.append((row["part"], row["ordinal"] + 1 + k, row["block"], doc, True, row["first"] + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    pieces = blocks.mapInArrow(run, piece)

    def crc_of(batches):
        for batch in batches:
            out = []
            for pieces_of in batch.column("pieces").to_pylist():
                crc = 0
                for p in pieces_of:
                    crc = join_crc(crc, p["crc"], 4 * p["n"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["pieces"]).columns, pa.array(out, pa.int64())], ["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    documents = pieces.groupBy("part", "ordinal").agg(
        F.max(F.when(F.col("begins"), F.col("doc_id"))).alias("doc_id"),
        F.max("start").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"),
    )
    documents = documents.select("part", "doc_id", "start", "n_tokens", "pieces").mapInArrow(
        crc_of, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    parts = land(parts.select("part", "before"), scratch_path(spark, "parts"))  # a row for each part
    return documents.join(parts, "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark, path: str) -> DataFrame:
    """``part``, ``block`` and the block's ``ids``."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")

    def run(batches):
        for group, decoded in _decoded(batches, shared.value):
            ids = pa.array([d.astype(np.int64) for d in decoded], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([group.column("part"), group.column("block"), ids], ["part", "block", "ids"])

    return blocks.select("part", "block", "payload").mapInArrow(run, "part int, block bigint, ids array<bigint>")
