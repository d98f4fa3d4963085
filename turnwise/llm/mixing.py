"""Mixing sources to target weights: Efraimidis-Spirakis order, prefix sums to token budgets, complete epochs first."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.sources.scratch import land, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>!"
LEAST_QUALITY = 0.1
BUCKETS = 4096
RATES = tuple(LEAST_QUALITY ** (1 - i / 3) for i in range(4))  # from the least quality to 1


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def symbol_quality(text: Column, words: Column) -> Column:
    """Between ``LEAST_QUALITY`` and 1: the fewer symbol characters a word, the higher."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return LEAST_QUALITY + (1 - LEAST_QUALITY) * (1 - F.least(F.lit(1.0), F.coalesce(symbols, F.lit(0)) / F.greatest(F.lit(1), words)))


def uniform(seed: int, *parts: Column) -> Column:
    """A number between 0 and 1 from 52 bits of a digest; null parts count as a text of their own."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def key_bucket(key: Column, buckets: int) -> Column:
    """Which of ``buckets`` ranges of the order of keys a key lies in, none of them with much of a source, whatever its qualities.

    Ranges have equal mass under an equal mixture of exponential laws at ``RATES``. A key at a rate between two of those is at
    most their ratio (2.2) as dense as the lower one's law, so a range expects less than 4 x 2.2 / ``buckets`` of a source's
    documents (0.21 % of them with 4,096), be all of them symbols, none, or any mixture."""
    tail = sum((F.exp(-rate * key) for rate in RATES[1:]), F.exp(-RATES[0] * key))
    return F.floor(buckets * (1 - tail / len(RATES))).cast("int")


def measured(docs: DataFrame, keep: Iterable[str], seed: int = 11, buckets: int = BUCKETS) -> DataFrame:
    """``row`` (struct of the columns to keep), ``source``, ``size`` (words of the text), ``key`` and ``bucket``.

    ``key`` is exponential with the document's quality as rate: ascending order samples without replacement in proportion
    to quality. It depends on doc_id, text and seed alone, so repeated rows share one. ``bucket`` cuts the order of keys into ranges
    (``key_bucket``). A null text has the size 0 and is told apart from an empty one; doc_id may be of any type. No documents give no rows."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col("source").alias("source"),
        F.col("text").alias("text"),
        n_words(F.col("text")).alias("size"),
        uniform(seed, F.col("doc_id"), F.md5("text")).alias("u"),
    )
    rows = rows.withColumn("key", -F.log("u") / symbol_quality(F.col("text"), F.col("size")))
    return rows.select("row", "source", "size", "key", key_bucket(F.col("key"), buckets).alias("bucket"))


def targets(sizes: DataFrame, share: float, weights: Sequence[float], most: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from (source, source_size).

    Sources by code point, null last, take the weights in turn. The total is ``share`` of all sizes. A source whose part would
    exceed ``most`` times its size stops there and the excess is reshared by weight, until none is above: in order of
    size by weight, a source is at its limit if it is below what its weight gets of what those before it leave."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    table = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("at_limit", F.col("limit") * F.sum("weight").over(onward) <= F.col("left") * F.col("weight"))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("at_limit"), F.col("limit")).otherwise(0.0)).over(everything))
        .withColumn("rest_weight", F.sum(F.when(F.col("at_limit"), 0.0).otherwise(F.col("weight"))).over(everything))
    )
    return table.select(
        "source",
        "source_size",
        F.when(F.col("at_limit"), F.col("limit")).otherwise(F.try_divide(F.col("rest") * F.col("weight"), F.col("rest_weight"))).alias("target"),
    )


def mix(rows: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), most: float = 2.0, narrow: DataFrame | None = None) -> DataFrame:
    """``measured`` rows with ``source_size``, ``target`` and ``taken`` (words the mix takes, repeats counted).

    Every document is taken once for each complete epoch of its source's target. What is left of the target is
    filled in order of keys: whole documents up to the one that crosses it, of which the part that fits is taken. Rows that
    are equal share a key; such a group crosses as one, its rows taking equal parts. Null and empty texts take nothing; a null
    source is one like any other. A table without rows, or whose texts have no words, takes nothing.

    Sums by (source, bucket) find the bucket each source's target ends in; only that bucket's rows are sorted. So a
    source with a third of all rows is never in one task. ``narrow`` are the same rows without their ``row``, landed, if the
    caller has them; otherwise they are written here."""
    spark = rows.sparkSession
    if narrow is None:
        narrow = land(rows.select("source", "size", "key", "bucket"), scratch_path(spark, "mix-sizes"))
    sums = land(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size")), scratch_path(spark, "mix-sums"))
    quotas = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    quotas = quotas.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    quotas = quotas.withColumn("fill", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(quotas, F.col("s").eqNullSafe(F.col("source")))
        .where("before <= fill and fill < before + size")
        .select(F.col("source").alias("s"), F.col("bucket").alias("edge"), "before", "fill")
    )
    edge = land(edge, scratch_path(spark, "mix-edges"))  # one row per source
    quotas = land(
        quotas.join(edge.select(F.col("s"), "edge"), F.col("s").eqNullSafe(F.col("source")), "left").drop("s"),
        scratch_path(spark, "mix-quotas"),
    )
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        narrow.join(edge, narrow["source"].eqNullSafe(edge["s"]) & (narrow["bucket"] == edge["edge"]))
        .groupBy("source", "key", "before", "fill")
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .select(
            F.col("source").alias("c_source"),
            F.col("key").alias("c_key"),
            F.floor(F.greatest(F.lit(0), F.least(F.col("size"), F.col("fill") - F.col("ahead"))) / F.col("n")).cast("long").alias("part"),
        )
    )
    crossing = land(crossing, scratch_path(spark, "mix-crossing"))
    q = quotas.withColumnRenamed("source", "q_source")
    return (
        rows.join(q, rows["source"].eqNullSafe(q["q_source"]), "left")
        .join(crossing, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("key") == F.col("c_key")) & (F.col("bucket") == F.col("edge")), "left")
        .withColumn(
            "extra",
            F.when(F.col("edge").isNull() | (F.col("bucket") > F.col("edge")), F.lit(0).cast("long"))
            .when(F.col("bucket") < F.col("edge"), F.col("size"))
            .otherwise(F.coalesce("part", F.lit(0).cast("long"))),
        )
        .select("row", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken whole, and one with its first words
    (joined by one space) if a part of it is taken. Null and empty texts are not in it; no documents give an empty mix."""
    rows = mix(measured(docs, docs.columns), **settings)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.withColumn("whole", whole).withColumn("part", (F.col("taken") - F.col("whole") * F.col("size")).cast("int"))
    counts = F.concat(F.array_repeat(F.lit(0), F.col("whole")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>")))
    rows = rows.select("row", F.explode(counts).alias("part"))
    text = F.col("row.text")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("part")), " ")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    out["text"] = F.when(F.col("part") == 0, text).otherwise(cut)
    return rows.select(*[value.alias(c) for c, value in out.items()])
