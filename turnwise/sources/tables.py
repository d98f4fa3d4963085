"""Tables of an evaluation: enriched conversations, responses, results, metrics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.inference import RESPONSE_SCHEMA
from turnwise.sources.buckets import default_buckets, write_buckets

CHUNKS = 16  # requests are sent in so many parts; no more than one of them is lost with a run


def write_qa(enriched: DataFrame, path: str) -> None:
    enriched.write.mode("overwrite").parquet(path)


def chunk_of(chunks: int = CHUNKS) -> Column:
    """The chunk of a request, by its id."""
    return F.pmod(F.xxhash64("request_id"), F.lit(chunks)).cast("int")


def write_requests(requests: DataFrame, path: str, chunks: int = CHUNKS) -> DataFrame:
    """Write requests once, in ``chunks`` folders by id and in buckets of ids within each, and go on from what was written. Joins by
    request, to find what is pending and to put outcomes beside requests, then move ids and outcomes only, no prompt."""
    buckets = default_buckets(requests.sparkSession, chunks)
    return write_buckets(requests.withColumn("chunk", chunk_of(chunks)), path, "request_id", buckets, "chunk")


def append_responses(responses: DataFrame, path: str) -> None:
    responses.write.mode("append").parquet(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses so far; none if the table is not there yet."""
    try:
        return spark.read.schema(RESPONSE_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESPONSE_SCHEMA)


def write_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Write the rows of one run, replacing that run's rows and no others."""
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)


def write_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    """Write ``(metric, value)`` rows of a run, replacing what the run has of the same stages. A metric's stage is its
    name up to the first slash."""
    (
        metrics.select("metric", "value", F.lit(run_id).alias("run_id"), F.split("metric", "/")[0].alias("stage"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id", "stage")
        .parquet(path)
    )
