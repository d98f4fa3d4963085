"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``. A session in local mode that names
    none, as in a test, gets a local folder; on a cluster, where every executor has a disk of its own, that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="turnwise-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/turnwise/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
