"""Tables that are written once by a key, so that joins on it leave them where they are."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

LAYOUT_SCHEMA = "key string, buckets int, partition_by string"


def default_buckets(spark: SparkSession, parts: int = 1) -> int:
    """Buckets for a table that is read in so many parts: each then has partitions of the usual size, and the table as many files."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual // parts, min(usual, 8))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to Parquet in buckets of ``key``, replacing what was there, and go on from what was written.

    Rows are moved once, here. The files are plain Parquet for any other reader. How they lie is written beside them, so another session
    finds it (``open_buckets``)."""
    spark = df.sparkSession
    buckets = buckets or default_buckets(spark)
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.bucketBy(buckets, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)
    layout = spark.createDataFrame([(key, buckets, partition_by)], LAYOUT_SCHEMA)
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}_layout")
    return spark.table(name)


def open_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_buckets`` wrote, in this session or another."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema(LAYOUT_SCHEMA).parquet(f"{path}_layout").first()
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parted = f"PARTITIONED BY ({layout.partition_by})" if layout.partition_by else ""
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {parted} "
            f"CLUSTERED BY ({layout.key}) SORTED BY ({layout.key}) INTO {layout.buckets} BUCKETS LOCATION '{path}'"
        )
        if layout.partition_by:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def _table_name(path: str) -> str:
    """One name for a path, so that a rewritten table leaves no other behind in the catalog."""
    return f"turnwise_{hashlib.md5(path.encode()).hexdigest()}"
