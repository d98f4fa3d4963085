"""Seeded order of conversations and exact train / val / test splits.

The order is that of ``md5("<seed>:<conv_id>")``. No step sorts all conversations in one place, and no step moves
texts: hashes are uniform, so a histogram over the first hex digits (at most 65,536 rows, whatever the input) tells
where each rank lies, and only hashes are shuffled. Positions and splits do not depend on the input's order or
partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import fixed

_HEX_DIGITS = 4
_POINTS = 1 << 32  # values of the eight hex digits that are compared with a ratio


def shuffle_key(conv_id: Column, seed: int = fixed.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), conv_id.cast("string")))


def _keys(ids: DataFrame, seed: int) -> DataFrame:
    key = shuffle_key(F.col("conv_id"), seed)
    # Never null, so that joins on the bucket put no null check, and with it the hash, in front of the scan.
    bucket = F.coalesce(F.substring(key, 1, _HEX_DIGITS), F.lit(""))
    return ids.select("conv_id", key.alias("shuffle_key"), bucket.alias("bucket"))


def _histogram(keys: DataFrame) -> DataFrame:
    """Rows per bucket, rows in the buckets before it, and rows in all; at most 16 ** _HEX_DIGITS rows."""
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keys.groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
        .withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))
    )


def seeded_order(ids: DataFrame, seed: int = fixed.SEED) -> DataFrame:
    """``(conv_id, shuffle_key, split_rank)``: position from 0 in the seeded order."""
    keys = _keys(ids, seed)
    offsets = F.broadcast(_histogram(keys).select("bucket", "before"))  # at most 65,536 rows
    within = Window.partitionBy("bucket").orderBy("shuffle_key", "conv_id")
    return keys.join(offsets, "bucket").select(
        "conv_id", "shuffle_key", (F.col("before") + F.row_number().over(within) - 1).alias("split_rank")
    )


def _last_keys(ids: DataFrame, train_ratio: float, val_ratio: float, seed: int) -> DataFrame:
    """One row: the greatest key of train, and that of train and val together. Only the (at most two) buckets those
    keys lie in are ranked."""
    keys = _keys(ids, seed)
    n_train = F.floor(F.col("total") * F.lit(float(train_ratio)))
    n_val = F.floor(F.col("total") * F.lit(float(val_ratio)))
    edges = F.array(
        F.struct(F.lit("train").alias("edge"), n_train.alias("upto")),
        F.struct(F.lit("val").alias("edge"), (n_train + n_val).alias("upto")),
    )
    wanted = (
        _histogram(keys)
        .select("bucket", "before", "n", F.inline(edges))
        .filter((F.col("before") < F.col("upto")) & (F.col("upto") <= F.col("before") + F.col("n")))
        .select("bucket", "edge", (F.col("upto") - F.col("before")).alias("nth"))
    )
    within = Window.partitionBy("edge", "bucket").orderBy("shuffle_key", "conv_id")
    return (
        keys.join(F.broadcast(wanted), "bucket")  # two rows
        .withColumn("rn", F.row_number().over(within))
        .filter(F.col("rn") == F.col("nth"))
        .agg(*[F.max(F.when(F.col("edge") == e, F.col("shuffle_key"))).alias(e) for e in ("train", "val")])
    )


def assign_splits(
    conversations: DataFrame,
    ids: DataFrame | None = None,
    train_ratio: float = fixed.TRAIN_RATIO,
    val_ratio: float = fixed.VAL_RATIO,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split`` and ``shuffle_key``. Train takes ``int(n * train_ratio)`` conversations, val
    ``int(n * val_ratio)``, test the rest.

    ``ids`` is a cheaper frame with the same ``conv_id`` values, if there is one. Rows are compared with two keys
    found by a subquery, so they stay where they are."""
    ids = conversations.select("conv_id") if ids is None else ids
    last = _last_keys(ids, train_ratio, val_ratio, seed).select(F.struct("train", "val")).scalar()
    key = shuffle_key(F.col("conv_id"), seed)
    return conversations.withColumn("shuffle_key", key).withColumn(
        "split",
        F.when(F.col("shuffle_key") <= last.getField("train"), "train")
        .when(F.col("shuffle_key") <= last.getField("val"), "val")
        .otherwise("test"),
    )


def assign_stable_splits(
    conversations: DataFrame,
    train_ratio: float = fixed.TRAIN_RATIO,
    val_ratio: float = fixed.VAL_RATIO,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Add ``split`` and ``shuffle_key``, each conversation by itself: its key, as a number between 0 and 1, is compared with the ratios.

    Nothing is counted, sorted or moved, so this runs on streams too, and a conversation stays in its split however the data grows: with
    the same seed, more train never takes from val what it did not have before. Sizes are those of ``assign_splits`` up to
    sampling error, the square root of n * ratio * (1 - ratio). A null ``conv_id`` has no split."""
    if min(train_ratio, val_ratio) < 0 or train_ratio + val_ratio > 1:
        raise ValueError(f"ratios of {train_ratio} and {val_ratio} leave no room")
    keyed = conversations.withColumn("shuffle_key", shuffle_key(F.col("conv_id"), seed))
    point = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("bigint")
    first, second = (F.lit(math.floor(r * _POINTS)) for r in (train_ratio, train_ratio + val_ratio))
    split = F.when(point < first, "train").when(point < second, "val").when(point.isNotNull(), "test")
    return keyed.withColumn("split", split)


def split_sizes(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("split").agg(F.count("*").alias("n"))
