"""Sources of conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import fixed
from turnwise.operators.turns import TURNS_TYPE, at_least, clean_turns
from turnwise.sources.arrays import recut_arrays
from turnwise.sources.scratch import land

RAW_SCHEMA = "id string, conversations array<struct<from:string,value:string>>"
TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def read_raw(
    spark: SparkSession, data_files: Sequence[str], json_lines: bool = False, recut: str | None = None
) -> DataFrame:
    """JSON conversations ``{"id", "conversations": [{"from", "value"}, …]}``; other fields are not read.

    Files with one object per line (``json_lines``) are split like any text. Files that hold one JSON array each are read by
    one task per file, unless ``recut`` names a folder for their objects: then they are read in ranges by as many tasks as
    their size asks for, and cut into objects once (``recut_arrays``)."""
    if recut is not None and not json_lines:
        objects = recut_arrays(spark, data_files, recut)
        return objects.select(F.from_json("value", RAW_SCHEMA).alias("object")).select("object.*")
    return spark.read.schema(RAW_SCHEMA).option("multiLine", not json_lines).json(list(data_files))


def read_source(
    spark: SparkSession,
    data_files: Sequence[str] | None = None,
    table: str | None = None,
    split: str | None = None,
    json_lines: bool = False,
) -> DataFrame:
    """Raw conversations out of ``data_files``, or out of a table of the catalog if no files are named. A table with
    a ``split`` column is read for one split, by default ``train``; naming one of a table without is an error."""
    if data_files:
        return read_raw(spark, data_files, json_lines)
    if table is None:
        raise ValueError("name data_files or a table")
    df = spark.read.table(table)
    if "split" in df.columns:
        return df.filter(F.col("split") == (split or "train"))
    if split:
        raise ValueError(f"table {table} has no column to find the split {split!r} by")
    return df


def nested(raw: DataFrame) -> DataFrame:
    """Raw conversations as nested ones: ``(conv_id, conversation_id, turns)``.

    Nothing makes ``id`` unique in the raw data, and equal ids are different conversations, so ``conv_id`` is a hash of
    the row's content, and of a number among fully equal rows; ``id`` (or "") stays beside it as ``conversation_id``. The
    set of ids depends on the content alone, not on files or partitions. Rows are moved once, by content and input
    partition: those of a partition are numbered by themselves and moved up by the counts of earlier partitions, so a
    conversation that is repeated a million times is in many tasks."""
    content = F.sha2(F.to_json(F.struct("id", "conversations"), {"ignoreNullFields": "false"}), 256)
    keyed = raw.select("id", "conversations", content.alias("content"), F.spark_partition_id().alias("part"))
    within = Window.partitionBy("content", "part").orderBy("part")
    earlier = Window.partitionBy("content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("content", "part").agg(F.count("*").alias("n"))
    counts = counts.select("content", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = keyed.withColumn("nth", F.row_number().over(within)).join(counts, ["content", "part"])
    conv_id = F.sha2(F.concat_ws("#", "content", (F.col("before") + F.col("nth")).cast("string")), 256)
    turns = F.transform(
        F.coalesce("conversations", F.array().cast("array<struct<from:string,value:string>>")),
        lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["from"].alias("role"), t["value"].alias("text")),
    )
    return numbered.select(
        conv_id.alias("conv_id"),
        F.coalesce("id", F.lit("")).alias("conversation_id"),
        turns.cast(TURNS_TYPE).alias("turns"),
    )


def land_conversations(raw: DataFrame, path: str, min_turns: int = fixed.MIN_TURNS) -> DataFrame:
    """Clean and filter raw conversations and write them as one Parquet table."""
    return land(at_least(clean_turns(nested(raw)), min_turns), path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Flat turns out of Parquet."""
    return spark.read.schema(TURN_SCHEMA).parquet(path)
