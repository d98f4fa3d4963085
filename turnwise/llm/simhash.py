"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles that population counts choose."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.components import components
from turnwise.llm.lookups import look_up
from turnwise.llm.ngram_join import labels_of
from turnwise.llm.tasks import annotate
from turnwise.llm.words import Words, find_words, joined, signed
from turnwise.sources.scratch import land, scratch_path

WIDTH = 3
RADIUS = 2
SEED = 42  # of XXH64
BITS = 64
TILE = 4096  # fingerprints of a tile, about
COMPARED = 1 << 20  # pairs compared at once
BLOCK = 1 << 16  # shingles whose bits are added up at once


def shingle_spans(words: Words, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(words of all texts joined by one space, where each shingle starts and ends there, the shingles' bounds by text).

    A text of fewer words than ``width``, but not none, has one shingle of all of them."""
    sizes = words.ends - words.starts + 1
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes - 1
    counts = words.counts
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(shingles)))
    text = np.repeat(np.arange(len(counts)), shingles)
    first = words.offsets[text] + np.arange(bounds[-1]) - bounds[text]
    last = first + np.minimum(width, counts[text]) - 1
    return joined(words.data, words.starts, words.ends), starts[first], ends[last], bounds


def fingerprints(words: Words, width: int = WIDTH) -> np.ndarray:
    """A bit is one if it is set in over half of a text's shingle hashes, repeats included. No words give zero."""
    from xxhash import xxh64_intdigest

    data, starts, ends, bounds = shingle_spans(words, width)
    counts = np.zeros((len(bounds) - 1, BITS), np.int64)
    for low in range(0, len(starts), BLOCK):
        high = min(low + BLOCK, len(starts))
        spans = zip(starts[low:high].tolist(), ends[low:high].tolist())
        hashes = np.fromiter((xxh64_intdigest(data[i:j], SEED) for i, j in spans), np.uint64, high - low)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin, end = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, high, "left")
        texts = np.arange(begin, end)
        texts = texts[bounds[texts + 1] > bounds[texts]]
        counts[texts] += np.add.reduceat(bits, np.maximum(bounds[texts], low) - low, axis=0, dtype=np.int64)
    ones = 2 * counts > np.diff(bounds)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def parts_for(n: int) -> int:
    """In how many parts fingerprints are counted: the more, the fewer pairs of tiles are left, and the more pairs each tile is asked for."""
    return 4 if n < 1 << 20 else 8 if n < 1 << 31 else 16


def population(fingerprint: Column, parts: int) -> Column:
    """Set bits of each part of a fingerprint, as an array."""
    width = BITS // parts
    mask = F.lit(-1 if width == BITS else (1 << width) - 1).cast("bigint")
    return F.array(*[F.bit_count(F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(mask)) for i in range(parts)])


def steps_within(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that add up to ``radius`` at most, one of each two that mirror each other, and not none."""
    found = {(0,) * parts}
    for _ in range(radius):
        found |= {(*d[:i], d[i] + s, *d[i + 1 :]) for d in found for i in range(parts) for s in (-1, 1)}
    return sorted(d for d in found if d > (0,) * parts)


def close_pairs(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within ``radius`` bits; within ``x`` alone if there is no ``y``."""
    other = x if y is None else y
    rows = max(1, COMPARED // max(len(other), 1))
    found = []
    for low in range(0, len(x), rows):
        a, b = np.nonzero(np.bitwise_count(x[low : low + rows, None] ^ other[None, :]) <= radius)
        a = a + low
        if y is None:
            a, b = a[a < b], b[a < b]
        found.append((a, b))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))


def _compare(radius: int):
    """Edges of a forest that connects what the pairs within the radius connect: rows grow with fingerprints, not with pairs."""

    def run(batches):
        for batch in batches:
            mine, other = batch.column("mine"), batch.column("other")
            edges = []
            for i in range(batch.num_rows):
                x = mine[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = other[i].values.to_numpy(zero_copy_only=False).view(np.uint64) if other[i].is_valid else None
                a, b = close_pairs(x, y, radius)
                both = x if y is None else np.concatenate([x, y])
                label = labels_of(len(both), a, b if y is None else b + len(x))
                at = np.flatnonzero(label != np.arange(len(both)))
                edges.append((both[at], both[label[at]]))
            u, v = (np.concatenate([e[i] for e in edges]) if edges else np.empty(0, np.uint64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(signed(v))], ["u", "v"])

    return run


def links(nodes: DataFrame, n: int, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """(``u``, ``v``): edges that connect all distinct fingerprints within ``radius`` bits of each other, directly or through others.

    Fingerprints with the same population counts in all ``parts`` of their bits make tiles; more than ``tile`` of them are cut by hash. Bits that differ change
    some count by one each, so two tiles whose counts differ by more than the radius in sum have no link and are skipped. All other pairs of tiles, and every
    tile with itself, are compared whole. Each pair of tiles is a row of its own, in any task."""
    spark = nodes.sparkSession
    parts = parts_for(n) if parts is None else parts
    counted = nodes.select("fingerprint", population(F.col("fingerprint"), parts).alias("counts"))
    sizes = counted.groupBy("counts").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    dealt = counted.join(sizes, "counts").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    made = dealt.groupBy("counts", "blocks", "block").agg(F.collect_list("fingerprint").alias("prints"))  # bounded: about ``tile``
    tiles = land(made, scratch_path(spark, "tiles"))
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in steps_within(parts, radius)])
    reached = tiles.select("prints", "counts", F.explode(steps).alias("step"))
    reached = reached.select(F.col("prints").alias("mine"), F.zip_with("counts", "step", lambda c, s: c + s).alias("there"))
    beyond = reached.where(F.forall("there", lambda c: c.between(0, BITS // parts)))
    across = beyond.join(tiles.select(F.col("counts").alias("there"), F.col("prints").alias("other")), "there").select("mine", "other")
    # Blocks of one tile meet each other and themselves.
    within = tiles.where("blocks > 1").select("counts", "block", F.col("prints").alias("mine"))
    blocks = tiles.where("blocks > 1").select("counts", F.col("block").alias("later"), F.col("prints").alias("other"))
    within = within.join(blocks, "counts").where("block < later").select("mine", "other")
    alone = tiles.select(F.col("prints").alias("mine"), F.lit(None).cast("array<bigint>").alias("other"))
    pairs = across.unionAll(within).unionAll(alone)
    # Rows are few bytes but much work, so they are dealt anew, and not by size.
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(count, F.xxhash64("mine", "other")).mapInArrow(_compare(radius), "u bigint, v bigint")


def link_fingerprints(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    radius: int = RADIUS,
    keep: list[str] | None = None,
    parts: int | None = None,
    tile: int = TILE,
) -> DataFrame:
    """``row`` (struct of a document's columns), ``fingerprint`` (bigint, its 64 bits) and ``component_id``: the least doc_id of all documents whose
    fingerprints can be reached in steps of ``radius`` differing bits at most, its own included.

    A-Z are lower-cased and words end at the space and U+0009..U+000D. Shingles of ``width`` words joined by one space, repeats included, are
    hashed by XXH64. A null text, an empty one and one without words has the fingerprint zero, which is linked like any other. Repeated rows have one
    fingerprint. Null doc_ids count as greater than all others; a component of only such has a null id. An empty table gives an empty one.

    Rows with one fingerprint are one node; only nodes are compared and connected. How they are cut into ``parts`` and tiles changes no result."""
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)

    def begin():
        return lambda column: [pa.array(signed(fingerprints(find_words(column, lower=True), width)))]

    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = annotate(source, "text", begin, "fingerprint bigint", keep=["row", "doc_id"]).select("row.row", "row.doc_id", "fingerprint")
    made = land(made, scratch_path(spark, "fingerprints"))
    nodes = made.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = land(nodes, scratch_path(spark, "nodes"))
    total, n = nodes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    roots = components(land(links(nodes, n, radius, parts, tile), scratch_path(spark, "links")))
    rooted = nodes.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(linked, "root").where("node is not null or copies > 1").select("fingerprint", "copies", "component_id", F.lit(True).alias("told"))
    found = look_up(made, table, "fingerprint", "copies", total)
    # A document alone is its own component.
    return found.select("row", "fingerprint", F.when(F.col("told"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
