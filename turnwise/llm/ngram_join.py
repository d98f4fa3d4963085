"""Documents whose word shingles have a Jaccard similarity over a threshold: MinHash bands, Bayesian pruning, exact check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.components import components
from turnwise.llm.shingles import WIDTH, fingerprints, minhash, text_shingles
from turnwise.llm.tasks import annotate
from turnwise.llm.words import join_hash, scramble, signed
from turnwise.sources.scratch import land, scratch_path

THRESHOLD = 0.8
TOLERANCE = 1e-7  # a pair is dropped when its chance of reaching the threshold is below this
MISS = 1e-6  # chance that a pair at the threshold shares no band
BANDS, ROWS = 35, 5  # those of 0.8, where a pair at 0.85 is missed in 1 of 10**9 cases; fewest bands and most rows of any threshold
VALUES = 400  # MinHash values of a text at most
STEP = 25  # MinHash values compared at a time
TILE_SETS = 1 << 10  # sets of one side of a tile, about; of the first stage
TILE_SHINGLES = 1 << 17  # shingles of one side of a tile, about; of the second stage
LEAST_SIZE = 256  # what a smaller set counts there, so that a tile has few sets too
PAIRS = 1 << 18  # pairs compared at once
LARGE_TILE = 1 << 12  # pairs of a tile that is compared by itself


def bands_for(threshold: float) -> tuple[int, int]:
    """Bands and rows with which a pair at the threshold is missed with a chance of ``MISS`` at most, with as many rows as ``VALUES``
    allows. Thresholds that need more values even with one row are refused."""
    from math import ceil, log, log1p

    if not 0 < threshold < 1:
        raise ValueError(f"the threshold has to be between 0 and 1: {threshold}")
    for rows in range(ROWS, 0, -1):
        bands = max(BANDS, ceil(log(MISS) / log1p(-(threshold**rows))))
        if bands * rows <= VALUES:
            return bands, rows
    raise ValueError(f"{VALUES} MinHash values do not reach a threshold of {threshold}")


def fewest_matches(n: int, threshold: float, tolerance: float) -> int:
    """The least number of equal values among ``n`` with which the similarity may still reach the threshold.

    With a uniform prior, the similarity after m equal values of n is Beta(m + 1, n - m + 1) distributed, and its chance of
    being over t is that of at most m successes in n + 1 trials of chance t."""
    from math import exp, lgamma, log

    total, trials = 0.0, n + 1
    for m in range(n + 1):
        total += exp(lgamma(trials + 1) - lgamma(m + 1) - lgamma(trials - m + 1) + m * log(threshold) + (trials - m) * log(1 - threshold))
        if total >= tolerance:
            return m
    return n


def prune(values: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of ``values`` that may reach the threshold, after comparing ever more of their MinHash values."""
    matches = np.zeros(len(a), np.int16)
    for lo in range(0, values.shape[1], STEP):
        part = np.ascontiguousarray(values[:, lo : lo + STEP])
        matches += (part[a] == part[b]).sum(axis=1, dtype=np.int16)
        alive = matches >= fewest_matches(min(lo + STEP, values.shape[1]), threshold, tolerance)
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b


def overlaps(values: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, exactly."""
    n = len(offsets) - 1
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(n), counts)
    _, column, seen = np.unique(values, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    owner, column = owner[shared], column[shared]
    if len(a) > 8 * n and n <= 4 * TILE_SETS:
        # Many pairs: products of the sets' incidence matrices, some thousand shingles at a time.
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((n, n), np.float32)
        width = 4096
        top = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, top, width):
            i, j = np.searchsorted(column, (lo, lo + width))
            rows, inverse = np.unique(owner[i:j], return_inverse=True)
            dense = np.zeros((len(rows), min(width, top - lo)), np.float32)
            dense[inverse, column[i:j] - lo] = 1
            total[np.ix_(rows, rows)] += dense @ dense.T
        return total[a, b].astype(np.int64)
    key = owner * np.int64(len(values) + 1) + column  # sorted by set
    key.sort()
    first = np.searchsorted(owner, np.arange(n + 1))
    out = np.zeros(len(a), np.int64)
    many = np.diff(first)
    lo = 0
    while lo < len(a):
        upto = np.cumsum(many[b[lo : lo + PAIRS]])
        hi = lo + max(1, int(np.searchsorted(upto, 1 << 22)))
        x, y = a[lo:hi], b[lo:hi]
        size = many[y]
        at = np.repeat(first[y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        want = np.repeat(x, size) * np.int64(len(values) + 1) + column_of(key, at, len(values) + 1)
        if len(want):
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            out[lo:hi] = np.bincount(np.repeat(np.arange(len(x)), size), weights=key[place] == want, minlength=len(x)).astype(np.int64)
        lo = hi
    return out


def column_of(key: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return key[at] % width


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row of each row's component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(group: np.ndarray, side: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same tile, in pieces; rows are sorted by tile, then side. A tile of a block with itself (``own``) pairs
    all its rows, any other pairs across: none if one of its blocks is empty.

    Small tiles share a piece; a large one has pieces of its own, so that no matrix spans more rows than a tile has."""
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for lo, hi in zip(edges[:-1], edges[1:]):
        left = lo + int((side[lo:hi] == 0).sum())
        if own[lo]:
            a, b = np.triu_indices(hi - lo, 1)
            a, b = a + lo, b + lo
        else:
            a, b = np.repeat(np.arange(lo, left), hi - left), np.tile(np.arange(left, hi), left - lo)
        if len(a) >= LARGE_TILE:
            for at in range(0, len(a), PAIRS):
                yield a[at : at + PAIRS], b[at : at + PAIRS]
            continue
        held.append((a, b))
        size += len(a)
        if size >= PAIRS:
            yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            held, size = [], 0
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])


def tiled(members: DataFrame, group: str, weight: str, limit: int) -> DataFrame:
    """Members of groups dealt into tiles: ``tile`` (hash of group and its two blocks) and ``side``.

    A group whose weights add up to more than ``limit`` is cut into blocks by hash, and each pair of its blocks is a tile
    of its own, in any task; a block meets itself in one tile. Groups of one member are left out."""
    sums = members.groupBy(group).agg(F.sum(weight).alias("weights"), F.count("*").alias("of"))
    sums = sums.where("of > 1").select(group, F.ceil(F.col("weights") / limit).cast("int").alias("blocks"))
    dealt = members.join(sums, group).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return dealt.select(
        F.xxhash64(F.col(group), low, high).alias("tile"),
        F.col(group),
        low.alias("low"),
        high.alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        *[c for c in members.columns if c != group],
    )


def in_tiles(tiles: DataFrame, group: str, work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, rows: int) -> DataFrame:
    """Runs ``work`` (rows, tile numbers, sides) over whole tiles, as many small ones at a time as ``rows`` allows."""
    keys = [group, "low", "high"]
    # A fixed number of partitions: tiles are few bytes but much work, so they must not be merged by size.
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_tiles = tiles.repartition(parts, "tile").sortWithinPartitions("tile", *keys, "side")

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def done(table):
            change = np.zeros(table.num_rows, bool)
            for key in ("tile", *keys):
                column = table.column(key)
                column = pa.concat_tables([pa.table({"x": column})]).combine_chunks().column("x")
                if pa.types.is_struct(column.type):
                    parts = [c.to_numpy() for c in column.combine_chunks().flatten()]
                else:
                    parts = [column.to_numpy()]
                for values in parts:
                    change[1:] |= values[1:] != values[:-1]
            return np.cumsum(change)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            table = pa.Table.from_batches(held)
            number = done(table)
            cut = int(np.searchsorted(number, number[-1]))  # the last tile may go on
            if cut:
                yield work(table.slice(0, cut), number[:cut], table.slice(0, cut).column("side").to_numpy())
            held = pa.Table.from_batches(held).slice(cut).to_batches()
            size = sum(b.num_rows for b in held)
        if size:
            table = pa.Table.from_batches(held)
            yield work(table, done(table), table.column("side").to_numpy())

    return sorted_tiles.mapInArrow(run, schema)


def _fixed(column, dtype, width) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of binary rows of 64-bit values."""
    rows = column.combine_chunks().to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64), np.concatenate(([0], np.cumsum([len(r) // 8 for r in rows]))).astype(np.int64)


def _nodes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    one, two = table.column("node").combine_chunks().flatten()
    return one.to_numpy(), two.to_numpy()


def _meets_itself(table: pa.Table) -> np.ndarray:
    return table.column("low").to_numpy() == table.column("high").to_numpy()


def _scan(width: int, n_bands: int, n_rows: int):
    def begin():
        def step(column):
            sets = text_shingles(column, width)
            one, two = fingerprints(sets)
            values = minhash(sets, n_bands * n_rows)
            bands = []
            for k in range(n_bands):
                mixed = np.full(len(values), k + 1, np.uint64)
                for i in range(k * n_rows, (k + 1) * n_rows):
                    mixed = join_hash(mixed, values[:, i].astype(np.uint64))
                bands.append(signed(scramble(mixed)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * n_bands + 1, n_bands, dtype=np.int32)), pa.array(np.stack(bands, 1).reshape(-1)))
            short = values.astype(np.uint16)
            node = pa.StructArray.from_arrays([pa.array(signed(one)), pa.array(signed(two))], ["one", "two"])
            return [node, pa.array(sets.counts.astype(np.int64)), bands, pa.array([r.tobytes() for r in short], pa.binary())]

        return step

    return begin


def link_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    width: int = WIDTH,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (struct of a document's columns), ``class_id`` (least doc_id of all documents it is linked to, directly or
    through others, itself included), ``n_links`` (other documents whose similarity reaches the threshold, copies included) and
    ``class_key`` (a key of the class, null without links; doc_ids may occur in several classes, keys do not).

    Words are separated by the space and U+0009..U+000D, unchanged. A text of fewer words than ``width`` has one shingle of all of
    them; null texts and texts without words have none and are linked to nothing: their class is their own doc_id. Null
    doc_ids count as greater than all others; a class of only such has a null id. Repeated rows are copies of each other. doc_id is cast to
    a whole number: an id that is none is an error. An empty table gives an empty result.

    1. Copies (equal shingle sets) are one node from here on; the many rows of a copied text never meet.
    2. Nodes that share a band of MinHash values are compared in tiles of bounded size: ever more values, a pair being dropped as
       soon as its posterior chance of reaching the threshold is below the tolerance. A tile sends out, for each node, the
       least node it may be linked with, through others or not: rows grow with nodes, not with pairs.
    3. Nodes that are so connected make groups, and a group's texts are compared in tiles: the same pruning,
       then exact intersections. Every pair within a group is in exactly one tile, so sums of a tile's counts are the links.
    4. Components of the exact links give the classes."""
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    n_bands, n_rows = bands_for(threshold)
    n_values = n_bands * n_rows
    body, own = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    key = F.xxhash64(own, body).alias("key")
    source = docs.select(row, own.alias("doc_id"), key, body.alias("text"))
    fields = "node struct<one: bigint, two: bigint>, size bigint, bands array<bigint>, hashes binary"
    scanned = land(
        annotate(source.select("row", "doc_id", "key", "text"), "text", _scan(width, n_bands, n_rows), fields, keep=["row", "doc_id", "key"]).select(
            "row.*", "node", "size", "bands", "hashes"
        ),
        scratch_path(spark, "minhash"),
    )
    nodes = scanned.where("size > 0").groupBy("node").agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("least"),
        F.min("key").alias("key"),
        F.first("size").alias("size"),
        F.first("bands").alias("bands"),
        F.first("hashes").alias("hashes"),
    )
    nodes = land(nodes, scratch_path(spark, "nodes"))

    # Stage 1: bands, narrow at first; MinHash values go along only where a band has several nodes.
    in_bands = nodes.select("node", F.explode("bands").alias("band"), F.lit(1).alias("one"))
    several = in_bands.groupBy("band").agg(F.count("*").alias("of")).where("of > 1").select("band")
    in_bands = in_bands.join(several, "band")
    members = in_bands.join(nodes.select("node", "hashes"), "node")

    def prune_tile(table, number, side):
        values = _fixed(table.column("hashes"), np.uint16, n_values)
        one, two = _nodes(table)
        pairs = [prune(values, a, b, threshold, tolerance) for a, b in _pairs(number, side, _meets_itself(table))]
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.empty(0, np.int64) for i in (0, 1))
        label = labels_of(len(one), a, b)
        at = np.flatnonzero(label != np.arange(len(one)))
        u = pa.StructArray.from_arrays([pa.array(one[at]), pa.array(two[at])], ["one", "two"])
        v = pa.StructArray.from_arrays([pa.array(one[label[at]]), pa.array(two[label[at]])], ["one", "two"])
        return pa.RecordBatch.from_arrays([u, v], ["u", "v"])

    node_type = "struct<one: bigint, two: bigint>"
    maybe = in_tiles(tiled(members, "band", "one", TILE_SETS), "band", prune_tile, f"u {node_type}, v {node_type}", TILE_SETS)
    groups = components(maybe)

    # Stage 2: texts of groups, one for each node.
    chosen = groups.join(nodes.select("node", "key", "copies", "size", "hashes"), "node")
    chosen = chosen.select("node", F.col("root").alias("group"), "key", "copies", "size", "hashes")
    chosen = land(chosen, scratch_path(spark, "chosen"))
    # A text is found by its key, which rows of equal doc_id and text share: those few are made one again below.
    wanted = scanned.select("key", "node").join(chosen.select("node", "key"), ["node", "key"]).select("key").distinct()
    texts = source.select("key", "text").join(wanted.hint("shuffle_hash"), "key")
    sets = annotate(texts, "text", lambda: _shingle_rows(width), f"node {node_type}, shingles binary", keep=["key"])
    sets = sets.select("row.key", "node", "shingles").dropDuplicates(["node", "key"])
    members = chosen.join(sets, ["node", "key"]).drop("key")

    def verify_tile(table, number, side):
        hashes = _fixed(table.column("hashes"), np.uint16, n_values)
        values, offsets = _lists(table.column("shingles"))
        size, copies = np.diff(offsets), table.column("copies").to_numpy()
        one, two = _nodes(table)
        n = len(one)
        links = np.zeros(n, np.int64)
        found = []
        for a, b in _pairs(number, side, _meets_itself(table)):
            a, b = prune(hashes, a, b, threshold, tolerance)
            if not len(a):
                continue
            rows = np.unique(np.concatenate([a, b]))
            taken, upto = _take(values, offsets, rows)
            both = overlaps(taken, upto, np.searchsorted(rows, a), np.searchsorted(rows, b))
            similar = both >= threshold * (size[a] + size[b] - both) - 1e-9
            a, b = a[similar], b[similar]
            links += np.bincount(a, weights=copies[b], minlength=n).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=n).astype(np.int64)
            found.append((a, b))
        a, b = (np.concatenate([p[i] for p in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        label = labels_of(n, a, b)
        at = np.flatnonzero(links)
        u = pa.StructArray.from_arrays([pa.array(one[at]), pa.array(two[at])], ["one", "two"])
        v = pa.StructArray.from_arrays([pa.array(one[label[at]]), pa.array(two[label[at]])], ["one", "two"])
        return pa.RecordBatch.from_arrays([u, v, pa.array(links[at])], ["u", "v", "links"])

    members = members.withColumn("weight", F.greatest("size", F.lit(LEAST_SIZE)))
    tiles = tiled(members, "group", "weight", TILE_SHINGLES)
    verified = in_tiles(tiles, "group", verify_tile, f"u {node_type}, v {node_type}, links bigint", TILE_SETS)
    verified = land(verified, scratch_path(spark, "links"))
    roots = components(verified)
    degrees = verified.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))

    rooted = nodes.select("node", "copies", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    # Only nodes with copies or links need a look-up; all other documents are their own class.
    told = rooted.join(classes, "root").join(degrees, "node", "left").where("copies > 1 or links is not null")
    told = told.select("node", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        scanned.select("row", "doc_id", "node", "size")
        .join(told, (scanned["node"] == told["node"]) & (F.col("size") > 0), "left")
        .select(
            "row",
            F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("n_links") > 0, F.col("root")).alias("class_key"),
        )
    )


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id (null last), among rows of that id the least hash of all columns.

    Rows to drop are found on hashes of rows; texts are moved once, to leave those rows out. Where several equal rows are a class's
    first, one of them stays. Null texts and texts without words are no copies of each other: all of them stay. An empty table gives an empty one."""
    spark = docs.sparkSession
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(
        F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(7), *columns).alias("h2")
    )
    narrow = hashed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "h1", "h2")
    found = link_documents(narrow, keep=["doc_id", "h1", "h2"], **settings).where("n_links > 0").select("row.*", "class_key")
    found = land(found, scratch_path(spark, "classes"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h1", "h2")
    firsts = found.groupBy("class_key").agg(F.min(rank).alias("first"))
    marked = found.join(firsts, "class_key").withColumn("is_first", rank == F.col("first"))
    rows = land(marked.groupBy("h1", "h2").agg(F.max("is_first").alias("is_first"), F.count("*").alias("n")), scratch_path(spark, "rows"))
    gone = rows.where("not is_first or n > 1").select("h1", "h2")
    rest = hashed.join(gone.hint("shuffle_hash"), ["h1", "h2"], "left_anti").select("row.*")
    again = rows.where("is_first and n > 1").select("h1", "h2")
    if again.isEmpty():
        return rest
    single = hashed.join(again, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("row").alias("row"))
    return rest.unionAll(single.select("row.*"))


def _take(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = offsets[rows + 1] - offsets[rows]
    upto = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(offsets[rows] - upto[:-1], size) + np.arange(upto[-1])], upto


def _shingle_rows(width: int):
    def step(column):
        sets = text_shingles(column, width)
        one, two = fingerprints(sets)
        node = pa.StructArray.from_arrays([pa.array(signed(one)), pa.array(signed(two))], ["one", "two"])
        at = pa.py_buffer((sets.offsets * 8).astype(np.int32))
        return [node, pa.Array.from_buffers(pa.binary(), len(sets.offsets) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(sets.values))])]

    return step
