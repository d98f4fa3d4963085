"""Joins of all rows with a table that has one row a key, where one key may hold a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000  # a key is hot if it holds more than one in so many rows: fewer than so many keys are


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``table`` (one row a key) beside them, null where it has no row for the key.

    ``weight`` is how many rows have the key, and ``total`` how many rows there are. Hot keys, of which there are fewer than ``HOT_SHARE``, are broadcast,
    so their rows stay where they are; all others are joined by shuffle, where none of them is large. A null key finds nothing."""
    others = [c for c in table.columns if c not in (key, weight)]
    hot = F.col(weight) * HOT_SHARE > total
    said = F.struct(*others)
    few = table.where(hot).select(F.col(key).alias("_hot_key"), said.alias("_hot"))
    many = table.where(~hot).select(F.col(key).alias("_key"), said.alias("_cold"))
    first = rows.join(F.broadcast(few), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    # Rows that are settled have no key for the second join; it would send all those nulls to one task, so they get keys that nothing has.
    settled = first.where("_hot is not null").select(*rows.columns, F.col("_hot").alias("_said"))
    rest = first.where("_hot is null").drop("_hot").join(many, F.col(key) == F.col("_key"), "left")
    rest = rest.select(*rows.columns, F.col("_cold").alias("_said"))
    return settled.unionAll(rest).select(*rows.columns, *[F.col(f"_said.{c}").alias(c) for c in others])
