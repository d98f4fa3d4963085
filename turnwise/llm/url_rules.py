"""URL rules by a sort-merge range join over reversed-host keys, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``[com, example, www]``; an empty host has no labels."""
    return F.when(F.length(host) == 0, F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, "[.]", -1)))


def _zone(labels: Column, depth: Column) -> Column:
    """The canonical key of the first labels, each closed by a dot, so that no label is a prefix of another."""
    return F.concat(F.lit("."), F.array_join(F.transform(F.slice(labels, F.lit(1), depth), lambda x: F.concat(x, F.lit("."))), ""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One row per zone and path prefix, with the rules that contain it (the rule itself last) as a stack.

    Rules have ``host``, ``path`` and ``verdict``. Null host or path count as empty; of rules with equal host and path,
    ``block`` wins over ``allow`` (the last verdict in order). An empty host fits every host. A rule's ancestors
    are found by an equi-join on its own prefixes, so a zone with many rules gives no pairs beyond those nested."""
    plain = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), UPPER, UPPER.lower()).alias("host"),
            F.coalesce("path", F.lit("")).alias("prefix"),
            F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        )
        .groupBy("host", "prefix")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", reversed_host(F.col("host")))
        .withColumn("depth", F.size("labels"))
    )
    plain = plain.select(_zone(F.col("labels"), F.col("depth")).alias("zone"), "prefix", "depth", "host", "verdict")
    inner = plain.select(
        "zone",
        "prefix",
        "depth",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))).alias("outer"),
    )
    outer = plain.select("zone", F.col("prefix").alias("outer"), F.struct(F.length("prefix").alias("n"), F.col("prefix"), "host", "verdict").alias("entry"))
    return (
        inner.join(outer, ["zone", "outer"])
        .groupBy("zone", "prefix", "depth")
        .agg(F.sort_array(F.collect_list("entry")).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Columns ``row`` (struct of the page's columns), ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest one wins, by
    characters of host and path together, then of the host. Without one, ``rule`` is null and ``verdict`` the default.

    A url is looked up once for each length of host suffix that occurs among the rules: under the key of such a zone,
    a rule's path prefix is an interval of sorted paths. Keys and starts of intervals are sorted together and swept; the
    stack of the last start holds all rules that may still be open, those that have ended are popped, and the innermost is
    the answer. Distinct (host, path) pairs are swept, never pages, and each zone is split over ``salts`` sorted
    runs (the number of shuffle partitions by default), to which the zone's rules are copied. Hence a host with a third
    of all pages is no single task. A null url has empty host and path; repeated pages give repeated rows. Without rules every
    page gets the default; without pages the result is empty."""
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(f"`{url}`")
    judged = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), url_host(at).alias("host"), url_path(at).alias("path"))
    nested = canonical_rules(rules)
    depths = [r.depth for r in nested.select("depth").distinct().collect()]  # at most the labels of a host name
    keys = judged.select("host", "path").distinct()
    probes = (
        keys.withColumn("labels", reversed_host(F.col("host")))
        .withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>")))
        .where(F.col("depth") <= F.size("labels"))
        .select(
            _zone(F.col("labels"), F.col("depth")).alias("zone"),
            F.pmod(F.xxhash64("host", "path"), F.lit(salts)).cast("int").alias("salt"),
            F.col("path").alias("at"),
            F.lit(None).cast(nested.schema["stack"].dataType).alias("stack"),
            "host",
        )
    )
    # Zones without rules need no sweep: their probes end here, before any sort.
    probes = probes.join(nested.select("zone").distinct(), "zone", "left_semi")
    starts = nested.select(
        "zone",
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
        F.col("prefix").alias("at"),
        "stack",
        F.lit(None).cast("string").alias("host"),
    )
    sweep = Window.partitionBy("zone", "salt").orderBy("at", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = probes.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("host is not null")
    still = F.filter("open", lambda rule: F.startswith(F.col("at"), rule["prefix"]))
    best = (
        swept.withColumn("inner", F.try_element_at(still, F.lit(-1)))
        .where("inner is not null")
        .groupBy("host", F.col("at").alias("path"))
        .agg(
            F.max(
                F.struct(
                    (F.length("inner.host") + F.col("inner.n")).alias("n"),
                    F.length("inner.host").alias("h"),
                    F.concat("inner.host", "inner.prefix").alias("rule"),
                    F.col("inner.verdict").alias("verdict"),
                )
            ).alias("best")
        )
    )
    return judged.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
