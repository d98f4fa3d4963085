"""Benchmark passages in documents: a prefix-filtered set join, verified word by word."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.tasks import annotate
from turnwise.llm.words import ALNUM, chunks, find_words, signed
from turnwise.sources.scratch import land, scratch_path

WINDOW = 10
BLOCK_WINDOWS = 200_000  # windows matched in one pass over the documents; bounds what a task holds
_PAIRS = 1 << 20  # candidate positions verified at once
_BITS = 20


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item`` (string, null as empty), ``tokens`` (hashes of the window's words in order) and ``key`` (their hash).

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window."""

    def begin():
        def step(column):
            words = find_words(column, ALNUM, lower=True)
            hashes = signed(words.hashes())
            lists = []
            for a, b in zip(words.offsets[:-1], words.offsets[1:]):
                lists.append([hashes[s : s + window].tolist() for s in range(a, max(a + (b > a), b - window + 1))] if b - a >= window else [hashes[a:b].tolist()] * int(b > a))
            return [pa.array(lists, pa.list_(pa.list_(pa.int64())))]

        return step

    made = annotate(benchmark, text, begin, "windows array<array<bigint>>", keep=[item])
    return made.select(F.coalesce(F.col(f"row.`{item}`").cast("string"), F.lit("")).alias("item"), F.explode("windows").alias("tokens")).withColumn(
        "key", F.xxhash64("tokens")
    )


def token_counts(docs: DataFrame, text: str, vocabulary: np.ndarray) -> DataFrame:
    """How often each word of a vocabulary (sorted hashes) occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, counts = shared.value, np.zeros(len(shared.value), np.int64)
        look = Lookup(known)
        for batch in batches:
            for part in chunks(batch, "text"):
                _, at = look.find(find_words(part.column("text"), ALNUM, lower=True).hashes())
                counts += np.bincount(at, minlength=len(known))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(signed(known[found])), pa.array(counts[found])], ["token", "n"])

    rows = docs.select(docs[f"`{text}`"].alias("text")).mapInArrow(run, "token bigint, n bigint")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))


class Lookup:
    """Positions of hashes in a sorted array; a bitmap over some of their bits turns most others away first."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self._slot(known)] = True

    @staticmethod
    def _slot(hashes):
        return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the known hashes, and their places in the sorted array."""
        if not len(self.known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.bitmap[self._slot(hashes)])
        at = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
        same = self.known[at] == hashes[maybe]
        return maybe[same], at[same]


@dataclass
class Index:
    """Windows of a block by their rarest word."""

    rare: np.ndarray  # sorted hashes of rarest words
    first: np.ndarray  # entries of word i are first[i] to first[i + 1]
    place: np.ndarray  # of each entry: where in its window the word stands
    length: np.ndarray
    tokens: np.ndarray  # entries by the longest window; zeros after a window's end
    items: list[list[str]]  # of each entry


def build_index(windows: list, counts: dict[int, int]) -> Index:
    """Orders each window's words by rarity over all documents (then by hash). All words of a window must occur, so its
    necessary prefix is the rarest one; the window is entered under that."""
    longest = max((len(w.tokens) for w in windows), default=0)
    tokens = np.zeros((len(windows), longest), np.uint64)
    length = np.array([len(w.tokens) for w in windows], np.int64)
    place = np.zeros(len(windows), np.int64)
    for i, w in enumerate(windows):
        tokens[i, : length[i]] = np.array(w.tokens, np.int64).view(np.uint64)
        place[i] = min(range(length[i]), key=lambda j: (counts.get(w.tokens[j], 0), w.tokens[j], j))
    chosen = tokens[np.arange(len(windows)), place] if len(windows) else np.empty(0, np.uint64)
    order = np.argsort(chosen, kind="stable")
    rare, first = np.unique(chosen[order], return_index=True)
    return Index(rare, np.append(first, len(windows)), place[order], length[order], tokens[order], [list(windows[i].items) for i in order])


def occurrences(index: Index, look: Lookup, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """(first word, entry) of each occurrence of a window. ``begin`` and ``end`` bound the text each word stands in."""
    at, word = look.find(hashes)
    many = index.first[word + 1] - index.first[word]
    upto = np.concatenate(([0], np.cumsum(many)))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + _PAIRS, "right")) - 1)
        n = many[lo:hi]
        entry = np.repeat(index.first[word[lo:hi]] - (upto[lo:hi] - upto[lo]), n) + np.arange(n.sum())
        here = np.repeat(at[lo:hi], n)
        start = here - index.place[entry]
        fits = (start >= begin[here]) & (start + index.length[entry] <= end[here])  # positional and length bounds
        start, entry = start[fits], entry[fits]
        for j in range(index.tokens.shape[1]):
            short = index.length[entry] <= j
            same = short | (hashes[np.minimum(start + j, len(hashes) - 1)] == index.tokens[entry, j])
            start, entry = start[same], entry[same]
        yield start, entry
        lo = hi


def _matcher(index: Index):
    look = Lookup(index.rare)

    def match(words, before_spans, before_items):
        n = len(words)
        marks = np.zeros(n + 1, np.int32)
        counts, text = words.counts, words.text_of()
        begin, end = np.repeat(words.offsets[:-1], counts), np.repeat(words.offsets[1:], counts)
        found: dict[int, set[str]] = {}
        for start, entry in occurrences(index, look, words.hashes(), begin, end):
            np.add.at(marks, start, 1)
            np.add.at(marks, start + index.length[entry], -1)
            for doc, e in np.unique(np.stack([text[start], entry]), axis=1).T.tolist():
                found.setdefault(doc, set()).update(index.items[e])
        for doc, spans in enumerate(before_spans):
            for a, b in spans or ():
                marks[words.offsets[doc] + a] += 1
                marks[words.offsets[doc] + b] -= 1
            if before_items[doc]:
                found.setdefault(doc, set()).update(before_items[doc])
        hit = np.cumsum(marks[:n]) > 0
        # Runs of hit words that end with their text.
        edge = np.zeros(n + 1, bool)
        edge[words.offsets] = True
        opens = hit & (edge[:n] | ~np.concatenate(([False], hit[:-1]))) if n else hit
        closes = hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))) if n else hit
        firsts, lasts = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        base = words.offsets[text[firsts]] if len(firsts) else firsts
        pairs = np.stack([firsts - base, lasts - base], axis=1).astype(np.int32)
        upto = np.searchsorted(firsts, words.offsets)
        n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[words.offsets])
        inner = pa.FixedSizeListArray.from_arrays(pa.array(pairs.reshape(-1)), 2).cast(pa.list_(pa.int32()))
        spans = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), inner)
        items = pa.array([sorted(found.get(i, ())) for i in range(len(counts))], pa.list_(pa.string()))
        return [pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), spans, items]

    return match


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (struct of a document's columns), ``n_words``, ``n_hit``, ``spans`` (word ranges that are hit, end
    exclusive) and ``items`` (sorted ids, as strings, of items with a window that occurs).

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Null or empty texts have no
    words and are never hit; items without words match nothing; a null item id counts as the empty string; repeated items
    are one, repeated documents are repeated. Without documents the result is empty; without items no document is hit.

    The distinct windows of the benchmark are dealt by hash into blocks of about ``block_windows``; each block is
    one pass over the documents, whose state (spans and items) a further pass goes on from. Within a block, words are
    counted over all documents, windows are entered under their rarest word, and a document's occurrences of such words are
    the candidates: position and length must fit the text, then all words are compared. No document is shuffled. Each block reads the
    documents twice (counts, then windows), so reads grow with the benchmark: two for each ``block_windows`` distinct windows of it."""
    spark = docs.sparkSession
    windows = item_windows(benchmark, item, item_text, window).groupBy("key", "tokens").agg(F.sort_array(F.collect_set("item")).alias("items"))
    windows = land(windows, scratch_path(spark, "windows"))
    blocks = max(1, math.ceil(windows.count() / block_windows))
    keep = list(docs.columns if keep is None else keep)
    state = None
    for block in range(blocks):
        mine = windows.where(F.pmod("key", F.lit(blocks)) == block).collect()  # about block_windows rows
        vocabulary = np.unique(np.array([t for w in mine for t in w.tokens], np.int64).view(np.uint64))
        counts = {r.token: r.n for r in token_counts(docs, text, vocabulary).collect()} if mine else {}
        shared = spark.sparkContext.broadcast(build_index(mine, counts))
        fields = "n_words bigint, n_hit bigint, spans array<array<int>>, items array<string>"
        if state is None:

            def begin(shared=shared):
                match = _matcher(shared.value)

                def step(column):
                    return match(find_words(column, ALNUM, lower=True), [], [])

                return step

            more = blocks > 1 and text not in keep
            state = annotate(docs, text, begin, fields, keep=keep + [text] * more)
        else:
            state = land(state, scratch_path(spark, "leaks"))
            state = _again(state, text, shared, fields)
    if blocks > 1 and text not in keep:
        state = state.withColumn("row", F.col("row").dropFields(f"`{text}`"))
    return state


def _again(state: DataFrame, text: str, shared, fields: str) -> DataFrame:
    flat = state.select("row", F.col(f"row.`{text}`").alias("text"), "spans", "items")
    out = state.select("row", "n_words", "n_hit", "spans", "items")

    def run(batches):
        match = _matcher(shared.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                made = match(find_words(part.column("text"), ALNUM, lower=True), part.column("spans").to_pylist(), part.column("items").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], ["row", "n_words", "n_hit", "spans", "items"])

    return flat.mapInArrow(run, out.schema)
