"""Passages that occur more than once: seeds on winnowed anchors, extended both ways, cut where they repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.tasks import annotate
from turnwise.llm.words import chunks, find_words, joined, run_hashes, second_lane, sha256, signed, slide_min
from turnwise.sources.scratch import land, scratch_path

THRESHOLD = 35
ANCHOR = 10
CHUNK_BYTES = 2 << 20  # texts whose windows are compared with each other before any are sent out
COMMON = 4096  # texts with an anchor beyond which the windows it is the anchor of are dealt over SALTS tasks
SALTS = 64
_PLACE = np.uint64(24)
_PIECE = 1 << 22


def own_anchors(runs: np.ndarray, width: int) -> np.ndarray:
    """Where the anchor of the window that begins at each place stands: the least of its ``width`` runs (the first of equals)."""
    out = np.empty(max(0, len(runs) - width + 1), np.int64)
    for lo in range(0, len(out), _PIECE):
        piece = runs[lo : lo + _PIECE + width - 1]
        marked = (piece >> _PLACE << _PLACE) | np.arange(len(piece), dtype=np.uint64)
        least = (slide_min(marked, width) & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64) + lo
        out[lo : lo + len(least)] = least
    return out


def anchors_and_own(hashes: np.ndarray, room: np.ndarray, threshold: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed anchors of a chunk, and the hash of the anchor of the window that begins at each place.

    Every window of ``threshold`` words that fits its text has at least one anchor wholly inside: its least run of
    ``anchor`` words. Equal windows have equal anchors at equal places, wherever they stand."""
    runs = run_hashes(hashes, anchor)
    own = own_anchors(runs, threshold - anchor + 1)
    chosen = np.zeros(len(runs), bool)
    chosen[own[room[: len(own)] >= threshold]] = True
    places = np.flatnonzero(chosen)
    return places, runs[places], runs[own]


def anchors(hashes: np.ndarray, room: np.ndarray, threshold: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed anchors of a chunk."""
    return anchors_and_own(hashes, room, threshold, anchor)[:2]


def _scan(threshold: int, anchor: int):
    """For each text: number of words, digest of its words, and its distinct anchors, as those found once and more often."""

    def begin():
        def step(column):
            words = find_words(column)
            hashes = words.hashes()
            places, seeds = anchors(hashes, words.room(), threshold, anchor)
            text = words.text_of()[places]
            order = np.lexsort((seeds, text))
            text, seeds = text[order], seeds[order]
            first = np.ones(len(seeds), bool)
            first[1:] = (seeds[1:] != seeds[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(first)
            often = np.diff(np.append(at, len(seeds))) > 1
            text, seeds = text[at], seeds[at]
            out = []
            for chosen in (~often, often):
                upto = np.searchsorted(text[chosen], np.arange(len(words.offsets)))
                out.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(signed(seeds[chosen]))))
            digests = [
                sha256(joined(words.data, words.starts[a:b], words.ends[a:b])) for a, b in zip(words.offsets[:-1], words.offsets[1:])
            ]
            return [pa.array(words.counts.astype(np.int64)), pa.array(digests, pa.string()), *out]

        return step

    return begin


def _windows(threshold: int, anchor: int):
    """Windows around repeated anchors, each sent out once a chunk.

    Rows of kind 0 are windows: two hashes, whether the chunk has it more than once, and the text and place it stands in if it
    has it once. Rows of kind 1 hold the places of a text's windows that are known to repeat (in its chunk, or as the
    text has copies). A window that any two texts share is thus sent out by each chunk, not by each text. ``hot`` marks windows whose
    own anchor many texts have, which is so wherever the window stands."""

    def set_of(column):
        return np.unique(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                words = find_words(part.column("text"))
                hashes, room = words.hashes(), words.room()
                places, seeds, own = anchors_and_own(hashes, room, threshold, anchor)
                places = places[np.isin(seeds, set_of(part.column("seeds")))]
                # Extension: every window that holds the anchor, from all of it on the left to all of it on the right.
                cover = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(cover, np.maximum(places - (threshold - anchor), 0), 1)
                np.add.at(cover, places + 1, -1)
                starts = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (room >= threshold))
                one, two = run_hashes(hashes, threshold)[starts], run_hashes(second_lane(hashes), threshold)[starts]
                text = words.text_of()[starts]
                copied = part.column("copies").to_numpy(zero_copy_only=False)[text] > 1
                order = np.lexsort((two, one))
                new = np.ones(len(order), bool)
                new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                group = np.cumsum(new) - 1
                size = np.bincount(group, minlength=1) if len(order) else np.zeros(1, np.int64)
                many = np.zeros(len(order), bool)
                many[order] = size[group] > 1 if len(order) else False
                many |= copied
                # A copied text alone makes its windows repeat, so all of a group are known as soon as one is.
                if len(order):
                    known = np.bincount(group, weights=many[order]) > 0
                    many[order] = known[group]
                sent = np.zeros(len(order), bool)
                sent[order[new]] = True
                place = (starts - words.offsets[text]).astype(np.int32)
                ref_one, ref_two = (part.column(c).to_numpy(zero_copy_only=False) for c in ("ref_one", "ref_two"))
                hot = np.isin(own[starts], set_of(part.column("common")))
                at = np.flatnonzero(sent)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(len(at), np.int8)),
                        pa.array(signed(one[at])),
                        pa.array(signed(two[at])),
                        pa.array(many[at]),
                        pa.array(hot[at]),
                        pa.array(ref_one[text[at]]),
                        pa.array(ref_two[text[at]]),
                        pa.array(place[at]),
                        pa.nulls(len(at), pa.list_(pa.int32())),
                    ],
                    NAMES,
                )
                at = np.flatnonzero(many & ~copied)
                docs = np.unique(text[at])
                if len(docs):
                    upto = np.searchsorted(text[at], np.append(docs, docs[-1] + 1))
                    lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(place[at]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.ones(len(docs), np.int8)),
                            pa.array(ref_one[docs]),
                            pa.array(ref_two[docs]),
                            pa.array(np.ones(len(docs), bool)),
                            pa.array(np.zeros(len(docs), bool)),
                            pa.array(ref_one[docs]),
                            pa.array(ref_two[docs]),
                            pa.array(np.zeros(len(docs), np.int32)),
                            lists,
                        ],
                        NAMES,
                    )

    return run


WINDOW_SCHEMA = "kind tinyint, one bigint, two bigint, many boolean, hot boolean, ref_one bigint, ref_two bigint, place int, places array<int>"
NAMES = [f.split()[0] for f in WINDOW_SCHEMA.split(", ")]


def _spans(threshold: int):
    """Word ranges covered by the windows that begin at ``places``, and the digest of the words outside them."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                words = find_words(part.column("text"))
                spans, removed, digests = [], [], []
                for doc, places in enumerate(part.column("places")):
                    at = np.unique(places.values.to_numpy())
                    cuts = np.flatnonzero(np.diff(at) > threshold)
                    begins, ends = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)] + threshold
                    keep = np.ones(words.counts[doc], bool)
                    for a, b in zip(begins, ends):
                        keep[a:b] = False
                    lo, hi = words.offsets[doc], words.offsets[doc + 1]
                    spans.append(np.stack([begins, ends], axis=1).tolist())
                    removed.append(int((~keep).sum()))
                    digests.append(sha256(joined(words.data, words.starts[lo:hi][keep], words.ends[lo:hi][keep])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("ref_one"),
                        part.column("ref_two"),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                        pa.array(digests, pa.string()),
                    ],
                    ["ref_one", "ref_two", "removed", "spans", "digest"],
                )

    return run


def _refs(text):
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("ref_one"), F.xxhash64(F.lit(7), text).alias("ref_two")


def find_repeats(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, anchor: int = ANCHOR, keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of a document's columns), ``n_words``, ``n_removed``, ``spans`` (word ranges to remove, end
    exclusive) and ``kept_sha256`` (of the other words, joined by one space).

    A word goes if a window of ``threshold`` words over it begins anywhere else too, in the same or another document.
    Null and empty texts have no words; texts below the threshold lose none; copies of a text of that many words lose all,
    repeated rows included. An empty table gives an empty result.

    1. Seed. One scan takes every text's winnowed anchors (about one in 13 words). Copies of a text are merged, then
       anchors are counted; an equal window anywhere has an equal anchor, so only windows around repeated ones matter.
    2. Extend. Texts with repeated anchors, one of all copies, give the windows that reach from the anchor up to the threshold
       both ways, with 128-bit hashes. Windows that a chunk of texts has more than once are settled there and leave it once.
    3. Keep. Windows are grouped by hash; those found twice or more are united per text into maximal ranges. Windows whose anchor
       stands in more than ``COMMON`` texts are first grouped in ``SALTS`` parts, and only what a part has once is looked for in the
       others, so a passage that every chunk has is no single task's.

    No pairs of documents are made: rows grow with the words that repeat, not with the square of a passage's documents."""
    spark = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    body = F.col(f"`{text}`")
    key = F.xxhash64(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0).cast("long")
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *_refs(body), key.alias("key"), body.alias("text"))
    scanned = annotate(
        source, "text", _scan(threshold, anchor), "n_words bigint, digest string, seeds array<bigint>, often array<bigint>", keep=["row", "ref_one", "ref_two", "key"]
    )
    scanned = land(scanned.select("row.*", "n_words", "digest", "seeds", "often"), scratch_path(spark, "anchors"))

    texts = scanned.where(F.col("n_words") >= threshold).groupBy("ref_one", "ref_two")
    texts = land(
        texts.agg(F.count("*").alias("copies"), F.min("key").alias("key"), F.first("seeds").alias("seeds"), F.first("often").alias("often")),
        scratch_path(spark, "texts"),
    )
    seeds = texts.select("ref_one", F.explode("seeds").alias("seed"), F.lit(1).alias("n")).unionAll(
        texts.select("ref_one", F.explode("often").alias("seed"), F.lit(2).alias("n"))
    )
    # Copies are no reason to look at a text again, but may be what another text's windows repeat.
    repeated = seeds.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed", (F.col("n") > COMMON).alias("common"))
    wanted = seeds.join(repeated, "seed").groupBy("ref_one")
    wanted = wanted.agg(F.collect_list("seed").alias("seeds"), F.collect_list(F.when(F.col("common"), F.col("seed"))).alias("common"))
    wanted = texts.select("ref_one", "ref_two", "copies", "key").join(wanted, "ref_one")
    candidates = source.select("ref_one", "ref_two", "key", "text").join(wanted.hint("shuffle_hash"), ["ref_one", "ref_two", "key"])
    candidates = land(candidates.select("ref_one", "ref_two", "copies", "seeds", "common", "text"), scratch_path(spark, "candidates"))

    windows = candidates.mapInArrow(_windows(threshold, anchor), WINDOW_SCHEMA)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("ref_one", "ref_two"), F.lit(SALTS))).otherwise(-1)
    same = Window.partitionBy("one", "two", "salt")
    windows = windows.withColumn("salt", salt).withColumn("n", F.count("*").over(same)).withColumn("any_many", F.max("many").over(same))
    windows = windows.withColumn("settled", F.expr("kind = 1 or n > 1 or any_many")).where("settled or hot")
    hash_of_hot = [F.when(F.col("hot"), F.col(c)).alias(c) for c in ("one", "two")]
    windows = land(
        windows.select("ref_one", "ref_two", F.when(F.col("kind") == 0, F.col("place")).alias("place"), "places", "hot", "settled", *hash_of_hot),
        scratch_path(spark, "windows"),
    )
    elsewhere = windows.where("hot").groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
    across = windows.where("hot and not settled").join(elsewhere, ["one", "two"], "left_semi")  # a window's rows: one a salt at most
    found = windows.where("settled").select("ref_one", "ref_two", "place", "places")
    found = found.unionAll(across.select("ref_one", "ref_two", "place", "places"))
    places = found.groupBy("ref_one", "ref_two").agg(F.collect_list("place").alias("single"), F.flatten(F.collect_list("places")).alias("several"))
    places = places.select("ref_one", "ref_two", F.concat("single", "several").alias("places"))
    cut = (
        candidates.where("copies = 1")
        .select("ref_one", "ref_two", "text")
        .join(places.hint("shuffle_hash"), ["ref_one", "ref_two"])
        .mapInArrow(_spans(threshold), "ref_one bigint, ref_two bigint, removed bigint, spans array<array<int>>, digest string")
        .withColumnRenamed("digest", "rest")
    )
    whole = F.col("copies") > 1
    everything = F.array(F.array(F.lit(0), F.col("n_words").cast("int")))
    out = scanned.drop("seeds", "often").join(texts.where("copies > 1").select("ref_one", "ref_two", "copies"), ["ref_one", "ref_two"], "left")
    out = out.join(cut, ["ref_one", "ref_two"], "left")
    return out.select(
        "row",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, everything).otherwise(F.coalesce("spans", F.array().cast("array<array<int>>"))).alias("spans"),
        F.when(whole, F.lit(sha256(b""))).otherwise(F.coalesce("rest", "digest")).alias("kept_sha256"),
    )


def kept_text(found: DataFrame, text: str = "text") -> DataFrame:
    """``row`` and ``kept``, the text without its ``spans``; ``row`` must have the text."""
    source = found.select("row", F.col(f"row.`{text}`").alias("text"), "spans")
    schema = source.select("row", F.lit("").alias("kept")).schema

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                words = find_words(part.column("text"))
                out = []
                for doc, spans in enumerate(part.column("spans").to_pylist()):
                    keep = np.ones(words.counts[doc], bool)
                    for a, b in spans:
                        keep[a:b] = False
                    lo, hi = words.offsets[doc], words.offsets[doc + 1]
                    out.append(joined(words.data, words.starts[lo:hi][keep], words.ends[lo:hi][keep]).decode())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out, pa.string())], ["row", "kept"])

    return source.mapInArrow(run, schema)
