"""JSON arrays of any size, re-cut into one object a row by many tasks.

Spark reads a file that holds one JSON array in one task. Here the file is read in byte ranges, like any text: a "line" ends at a closing brace, wherever that is. Whether a
range begins inside a string and how deep in objects follows from the quotes and braces of all ranges before it, a sum over one row a range. With that known, each range
gives the objects that lie in it, and the pieces of an object that lies in several are put together."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.sources.scratch import land

_QUOTE, _ESCAPE, _OPEN, _CLOSE = 0x22, 0x5C, 0x7B, 0x7D
RANGE_SCHEMA = "file string, block bigint, quotes bigint, outside bigint, inside bigint"
CUT_SCHEMA = "file string, block bigint, value string, piece int"
HEAD, TAIL = 0, 1  # pieces: up to an object's end, or through the whole range; from an object's begin to the range's end


def fragments(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """``(file, block, range, value)``: text up to each closing brace, which is left out; ``range`` is a hash of the range it was read in. The rows of a range follow
    each other in one partition."""
    text = spark.read.option("lineSep", "}").text(list(files))
    where = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    return where.select("file", "block", F.xxhash64("file", "block").alias("range"), "value")


def _bytes_of(values: pa.Array) -> np.ndarray:
    """The bytes of fragments, each with its closing brace."""
    return np.frombuffer(b"".join(x + b"}" for x in values.cast(pa.binary()).to_pylist()), np.uint8)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where strings begin and end. A quote after an odd number of backslashes is part of a string; there are none outside of strings."""
    found = data == _QUOTE
    escapes = data == _ESCAPE
    if escapes.any():
        at = np.flatnonzero(found)
        other = np.maximum.accumulate(np.where(escapes, -1, np.arange(len(data))))
        found[at[(at > 0) & ((at - 1 - other[np.maximum(at - 1, 0)]) % 2 == 1)]] = False
    return found


def _steps(data: np.ndarray, quotes: np.ndarray, inside: bool) -> np.ndarray:
    """How each byte changes the depth; braces in strings do not."""
    out = (data == _OPEN).astype(np.int64) - (data == _CLOSE)
    out[(np.cumsum(quotes) + inside) % 2 == 1] = 0
    return out


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(file, block and hash of a range, whether it is a new one, rows of it), as they come."""
    last = None
    for batch in batches:
        ids = batch["range"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))) if len(ids) else []
        for a, b in zip(edges[:-1], edges[1:]):
            rows = batch.slice(a, b - a)
            key = (rows["file"][0].as_py(), rows["block"][0].as_py(), int(ids[a]))
            yield key, key != last, rows
            last = key


def range_sums(cut: DataFrame) -> DataFrame:
    """One row a range: its quotes, and the change of depth if it begins outside and inside of a string."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None

        def row():
            return pa.RecordBatch.from_pylist([dict(zip(names, sums))], schema=kinds)

        for key, new, rows in _by_range(batches):
            if new:
                if sums:
                    yield row()
                sums = [key[0], key[1], 0, 0, 0]
            data = _bytes_of(rows["value"])
            quotes = _quotes(data)
            # A batch inside a range begins where the one before ended.
            flip = sums[2] % 2
            outside, inside = (int(_steps(data, quotes, bool(start ^ flip)).sum()) for start in (0, 1))
            sums[2:] = [sums[2] + int(quotes.sum()), sums[3] + outside, sums[4] + inside]
        if sums:
            yield row()

    names = ["file", "block", "quotes", "outside", "inside"]
    kinds = pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in names])
    return cut.mapInArrow(add_up, RANGE_SCHEMA)


def range_starts(sums: DataFrame) -> DataFrame:
    """``(range, inside, depth)``: how each range begins, if not outside of everything."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = sums.withColumn("inside_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    change = F.when(F.col("inside_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    deep = started.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    begun = deep.select(F.xxhash64("file", "block").alias("range"), F.col("inside_string").alias("inside"), "depth")
    return begun.filter("inside = 1 or depth > 0")


def cut_objects(cut: DataFrame, starts: pa.Table) -> DataFrame:
    """``(file, block, value, piece)``: whole objects (``piece`` null) and pieces of those that lie in several ranges. Line breaks, which stand between an object's fields
    only, become spaces."""
    order = np.argsort(starts["range"].to_numpy())
    shared = cut.sparkSession.sparkContext.broadcast(tuple(starts[c].to_numpy()[order] for c in ("range", "inside", "depth")))
    breaks = bytes.maketrans(b"\r\n", b"  ")

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, insides, depths = shared.value
        key, held, depth, inside, opened = None, [], 0, False, True

        def rows(values, pieces):
            n = len(values)
            text = pa.array([v.translate(breaks) for v in values], pa.binary()).cast(pa.string())
            columns = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), text, pa.array(pieces, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "value", "piece"])

        for this, new, part in _by_range(batches):
            if new:
                if depth > 0:
                    yield rows([b"".join(held)], [TAIL if opened else HEAD])
                at = int(np.searchsorted(ranges, this[2]))
                known = at < len(ranges) and ranges[at] == this[2]
                key, held, opened = this, [], False
                depth, inside = (int(depths[at]), bool(insides[at])) if known else (0, False)
            data = _bytes_of(part["value"])
            quotes = _quotes(data)
            steps = _steps(data, quotes, inside)
            after = depth + np.cumsum(steps)
            ends = np.flatnonzero((steps < 0) & (after == 0)) + 1
            begins = np.flatnonzero((steps > 0) & (after == 1))
            raw = data.tobytes()
            values, pieces = [], []
            if depth > 0:  # goes on with the object that is open
                held.append(raw[: ends[0]] if len(ends) else raw)
                if len(ends):
                    values.append(b"".join(held))
                    pieces.append(None if opened else HEAD)
                    held, ends = [], ends[1:]
            values += [raw[a:b] for a, b in zip(begins, ends)]
            pieces += [None] * len(ends)
            if len(begins) > len(ends):
                held, opened = [raw[begins[-1] :]], True
            # After the last brace of a file there is none; the one put there closes nothing.
            depth, inside = max(int(after[-1]), 0), bool((int(quotes.sum()) + inside) % 2)
            if values:
                yield rows(values, pieces)
        if depth > 0:
            yield rows([b"".join(held)], [TAIL if opened else HEAD])

    return cut.mapInArrow(objects, CUT_SCHEMA)


def recut_arrays(spark: SparkSession, files: Sequence[str], path: str) -> DataFrame:
    """``value``: one JSON object a row, out of files that hold arrays of objects, single objects or objects one after another, in any layout.

    The files are read twice, in ranges of ``spark.sql.files.maxPartitionBytes`` each, and written once, under ``path``. The driver and every task see 24 bytes a range.
    Values of an array that are no objects are left out. Compressed files are one range each, and files that are no JSON give no sensible objects."""
    cut = fragments(spark, files)
    sums = land(range_sums(cut), f"{path}/ranges")
    whole = land(cut_objects(cut, range_starts(sums).toArrow()), f"{path}/objects")
    # A tail opens an object; the heads after it, up to the next tail, belong to it.
    along = Window.partitionBy("file").orderBy("block", "piece")
    pieces = whole.filter("piece is not null").withColumn("nth", F.sum("piece").over(along))
    ordered = F.sort_array(F.collect_list(F.struct("block", "piece", "value")))
    joined = pieces.groupBy("file", "nth").agg(F.array_join(ordered["value"], "").alias("value"))
    return whole.filter("piece is null").select("value").unionAll(joined.select("value"))
