"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text, and how usual each such link is."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from turnwise.llm.tokens import _byte_letters
from turnwise.llm.words import arrow_bytes, chunks
from turnwise.sources.scratch import scratch_path

CHUNK_BYTES = 1 << 20
SHARED = 1 << 20  # id pairs whose counts are broadcast at most; all others are joined
HELD_PAIRS = 1 << 21  # id pairs a counting task holds before it passes its sums on
LONG_PIECE = 4096  # bytes without a space that are left to the file's own library

# Fixed value: how byte-level files of this kind cut a text before they merge bytes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"  # stands for a space in pieces


class ByteTokenizer:
    """Ids of a byte-level BPE file; names of special tokens inside texts are plain text.

    A file whose merges come in the order of its ids says the same as a table of ranks, which tiktoken applies several times as fast.
    Texts with characters younger than Unicode 3.2, whose classes the two libraries may see differently, and texts with very long
    stretches without a space are encoded by the file's own library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        byte = {letter: b for b, letter in _byte_letters().items()}
        names = self.own.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            self.bytes[number] = bytes(byte[letter] for letter in name) if all(x in byte for x in name) else name.encode()
        self.fast = self._ranked(said)
        self.old: dict[str, bool] = {}

    def _ranked(self, said: dict):
        model, cut = said["model"], said.get("pre_tokenizer") or {}
        vocabulary = model["vocab"]
        merged = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        in_order = all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merged))
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        odd = model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or said.get("normalizer") or said.get("truncation")
        added = {t["content"] for t in said["added_tokens"]}
        ranks = {self.bytes[number]: number for name, number in vocabulary.items() if name not in added}
        if model["type"] != "BPE" or not plain or odd or not in_order or len(ranks) != 256 + len(merged):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _simple(self, text: str) -> bool:
        for letter in set(text):
            if letter not in self.old:
                self.old[letter] = unicodedata.ucd_3_2_0.category(letter) != "Cn"
            if not self.old[letter]:
                return False
        if len(text) <= LONG_PIECE:
            return True
        spaces = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 0x20)
        return bool(len(spaces)) and int(np.diff(spaces, prepend=0, append=len(text.encode())).max()) <= LONG_PIECE and "    " * (LONG_PIECE // 4) not in text

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        left = []
        for i, text in enumerate(texts):
            if self.fast is not None and self._simple(text):
                out[i] = np.asarray(self.fast.encode_ordinary(text), np.uint32)
            else:
                left.append(i)
        for i, made in zip(left, self.own.encode_batch_fast([texts[i] for i in left], add_special_tokens=False) if left else []):
            out[i] = np.asarray(made.ids, np.uint32)
        return out


class PieceTokenizer:
    """Ids of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for number in range(self.own.piece_size()):
            piece = self.own.id_to_piece(number)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.own.is_byte(number) else piece.replace(MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, np.uint32) for ids in self.own.encode(texts, num_threads=1)] if texts else []


class Table:
    """Byte strings by number, one after another."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def gather(self, numbers: np.ndarray, room: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ``numbers`` joined, each followed by ``room`` bytes to be filled in, and where each ends."""
        sizes = self.sizes[numbers] + room
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[np.minimum(at, len(self.data) - 1)], ends


@dataclass
class Side:
    """Tokens of the texts of a chunk, one after another."""

    ids: np.ndarray
    offsets: np.ndarray  # text i has the tokens offsets[i] to offsets[i + 1]

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Side:
        flat = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
        return cls(flat, np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def only(self, good: np.ndarray) -> Side:
        counts = np.where(good, np.diff(self.offsets), 0)
        return Side(self.ids[good[self.text_of()]], np.concatenate(([0], np.cumsum(counts))))


class Aligner:
    """Both tokenizers of a worker, and what is read off their tokens."""

    _kept: dict[tuple, Aligner] = {}

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        if (path_a, path_b) not in cls._kept:
            cls._kept[path_a, path_b] = cls(path_a, path_b)
        return cls._kept[path_a, path_b]

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.bytes_a, self.bytes_b = Table(self.a.bytes), Table(self.b.bytes)
        self.n_b = len(self.b.bytes)
        self.decimal = Table([str(i).encode() for i in range(max(len(self.a.bytes), self.n_b))])

    @staticmethod
    def _spells(side: Side, table: Table, expected: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts the tokens spell byte by byte."""
        sizes = np.concatenate(([0], np.cumsum(table.sizes[side.ids])))
        good = np.diff(sizes[side.offsets]) == np.diff(bounds)
        found, _ = table.gather(side.only(good).ids)
        wanted = expected[np.repeat(good, np.diff(bounds))]
        wrong = np.flatnonzero(found != wanted)
        if len(wrong):
            ends = np.cumsum(np.where(good, np.diff(bounds), 0))
            good[np.searchsorted(ends, wrong, "right")] = False
        return good

    def tokens(self, column: pa.Array) -> tuple[Side, Side]:
        """Tokens of each text on both sides; none for empty texts and those that either side does not spell."""
        data, at = arrow_bytes(column)
        raw = data.tobytes()
        texts = [raw[i:j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        a = Side.of([x if text else x[:0] for x, text in zip(self.a.encode([" " + t for t in texts]), texts)])
        b = Side.of([x if text else x[:0] for x, text in zip(self.b.encode(texts), texts)])
        expected = np.insert(data, at[:-1], 0x20)
        bounds = at + np.arange(len(at))
        good = (np.diff(at) > 0) & self._spells(a, self.bytes_a, expected, bounds) & self._spells(b, self.bytes_b, expected, bounds)
        return a.only(good), b.only(good)

    def links(self, a: Side, b: Side) -> pd.DataFrame:
        """Tokens whose bytes overlap, as (``doc``, ``a``, ``b``), places in the two sides.

        Of two overlapping tokens, one begins inside the other: each token's start finds the other side's last token that begins no later, and
        the two directions together are all links. Where both begin at one byte, both directions say so."""
        frames = []
        for side, table, name in ((a, self.bytes_a, "a"), (b, self.bytes_b, "b")):
            sizes = table.sizes[side.ids]
            frames.append(pd.DataFrame({"start": np.cumsum(sizes) - sizes, "doc": side.text_of(), name: np.arange(len(side.ids))}))
        left, right = frames
        if not len(left):
            return pd.DataFrame({"doc": [], "a": [], "b": []}, dtype=np.int64)
        inside_b = pd.merge_asof(left, right, on="start", by="doc")
        begun = left["start"].to_numpy()
        later = right[~np.isin(right["start"].to_numpy(), begun, assume_unique=True)]
        inside_a = pd.merge_asof(later, left, on="start", by="doc")
        return pd.concat([inside_b[["doc", "a", "b"]], inside_a[["doc", "a", "b"]]], ignore_index=True)

    def groups(self, a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes ``a1,a2|b1;a3|b2,b3`` of all texts, where each text's end, and how many groups each text has."""
        ends_a, ends_b = np.cumsum(self.bytes_a.sizes[a.ids]), np.cumsum(self.bytes_b.sizes[b.ids])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        count_a, count_b = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        upto_a, before_b = np.cumsum(count_a), np.cumsum(count_b) - count_b
        ids = np.empty(len(a.ids) + len(b.ids), np.int64)
        marks = np.empty(len(ids), np.uint8)
        place_a, place_b = np.arange(len(a.ids)) + before_b[of_a], np.arange(len(b.ids)) + upto_a[of_b]
        ids[place_a], ids[place_b] = a.ids, b.ids
        marks[:] = ord(",")
        marks[np.flatnonzero(np.isin(np.arange(len(ids)), place_a[upto_a - 1]))] = ord("|")
        marks[place_b[before_b + count_b - 1]] = ord(";")
        out, ends = self.decimal.gather(ids, room=1)
        out[ends - 1] = marks
        tokens = np.diff(a.offsets) + np.diff(b.offsets)
        text_ends = np.concatenate(([0], ends))[np.cumsum(tokens)]
        last = np.searchsorted(both, np.concatenate(([0], ends_a))[a.offsets[1:]], "right")
        return out, text_ends, np.diff(last, prepend=0)

    def rows(self, column: pa.Array) -> list[pa.Array]:
        a, b = self.tokens(column)
        texts = len(column)
        out, ends, n_groups = self.groups(a, b)
        # A text's last mark is not part of its groups.
        keep = np.ones(len(out), bool)
        full = np.diff(ends, prepend=0) > 0
        keep[ends[full] - 1] = False
        at = np.concatenate(([0], ends - np.cumsum(full)))
        groups = pa.Array.from_buffers(pa.large_utf8(), texts, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[keep]))])
        found = self.links(a, b)
        doc = found["doc"].to_numpy(np.int64)
        pair = a.ids[found["a"].to_numpy(np.int64)] * self.n_b + b.ids[found["b"].to_numpy(np.int64)]
        n_links = np.bincount(doc, minlength=texts)
        size = len(self.a.bytes) * self.n_b
        keys, times = np.unique(doc * size + pair, return_counts=True)
        bounds = np.searchsorted(keys, np.arange(texts + 1) * size)
        counts = [pa.array(x.astype(np.int64)) for x in (np.diff(a.offsets), np.diff(b.offsets), n_groups, n_links)]
        return [*counts, groups.cast(pa.utf8()), binary(keys % size, bounds, np.uint32 if size <= 1 << 32 else np.uint64), binary(times, bounds, np.uint32)]


def binary(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    values = np.ascontiguousarray(values.astype(kind))
    at = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(at), pa.py_buffer(values)])


def unpack(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows of ``binary``, and the bounds of each."""
    data, at = arrow_bytes(column)
    return np.frombuffer(data.tobytes(), kind), at // np.dtype(kind).itemsize


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary"


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of a document's columns), ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``groups``, ``pairs`` and ``times``.

    ``path_a`` is a byte-level BPE file, which reads a space and the text, ``path_b`` a sentencepiece model that puts that space there itself. Byte offsets
    where tokens of both end cut them into ``groups``: ``a1,a2|b1;a3|b2,b3``, ids in order. Tokens that share bytes are linked; ``pairs`` holds the distinct
    pairs of ids so linked (a times the size of the second vocabulary, plus b) and ``times`` how often each is, as unsigned little-endian numbers.

    A null or empty text, and one that the tokens of either side do not spell byte by byte, has no tokens: zeros and empty values. Repeated rows are
    treated alike. Row by row, without a shuffle; an empty table gives an empty one. One text's tokens are held by one task."""
    keep = list(docs.columns if keep is None else keep)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    added = StructType.fromDDL(ALIGNED)
    schema = StructType([StructField("row", source.schema["row"].dataType), *added.fields])

    def run(batches):
        aligner = Aligner.of(path_a, path_b)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column("row"), *aligner.rows(part.column("text"))], ["row", *added.names])

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """``pair`` and ``n``, in how many documents it is linked. Each task adds up its documents first."""

    def run(batches):
        held, size = [], 0

        def summed():
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, many = keys[order], np.concatenate([m for _, m in held])[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(many, first)

        def batch_of(keys, many):
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(many)], ["pair", "n"])

        for batch in batches:
            values, _ = unpack(batch.column("pairs"), kind)
            if len(values):
                keys, many = np.unique(values, return_counts=True)
                held.append((keys, many.astype(np.int64)))
                size += len(keys)
            if size > HELD_PAIRS:
                held = [summed()]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield batch_of(*held[0])
                    held, size = [], 0
        if held:
            yield batch_of(*summed())

    return aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _shared_and_rest(counts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """At most ``SHARED`` pairs, those of the greatest counts, and the rest, if there is one."""
    bits = F.length(F.bin("n"))
    sizes = {r.bits: r.pairs for r in counts.groupBy(bits.alias("bits")).agg(F.count("*").alias("pairs")).collect()}  # 64 rows at most
    least, room = 65, SHARED
    for bit in sorted(sizes, reverse=True):
        if sizes[bit] > room:
            return counts.where(bits >= least), counts.where(bits < least)
        least, room = bit, room - sizes[bit]
    return counts, None


def count_links(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Puts the links of ``align_tokens`` beside the whole corpus: ``n_best``, links whose pair of ids is in as many documents as any pair of its first
    id, and ``count_sum``, the sum of those numbers over all links. All columns that are given stay, but for ``groups``, ``pairs`` and ``times``.

    The rows are written once, so that texts are encoded once. The counts of up to ``SHARED`` pairs, the most frequent, are broadcast (17 bytes each); links of all
    others meet theirs in a join, where none of them is frequent. Whole numbers, the same either way."""
    spark = aligned.sparkSession
    kind = "u4" if len(ByteTokenizer(path_a).bytes) * len(PieceTokenizer(path_b).bytes) <= 1 << 32 else "u8"
    n_b = len(PieceTokenizer(path_b).bytes)
    path = scratch_path(spark, "aligned")
    aligned.drop("groups").withColumn("uid", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    aligned = spark.read.parquet(path)
    path = scratch_path(spark, "pairs")
    first = F.floor(F.col("pair") / n_b)  # exact: pairs are far below 2 ** 53
    ranked = pair_counts(aligned, kind).withColumn("most", F.max("n").over(Window.partitionBy(first)))
    ranked.select("pair", "n", (F.col("n") == F.col("most")).alias("best")).write.parquet(path)
    often, rest = _shared_and_rest(spark.read.parquet(path))
    got = often.toArrow()
    order = np.argsort(got.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy()[order] for c in ("pair", "n", "best")))
    others = [c for c in aligned.columns if c not in ("pairs", "times")]
    said = StructType.fromDDL("n_best bigint, count_sum bigint, unknown array<struct<pair: bigint, times: bigint>>")
    schema = StructType([*[aligned.schema[c] for c in others], *said.fields])
    kinds = pa.struct([("pair", pa.int64()), ("times", pa.int64())])

    def run(batches):
        pairs, n, best = shared.value
        for batch in batches:
            values, bounds = unpack(batch.column("pairs"), kind)
            times = unpack(batch.column("times"), "u4")[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pairs, values), max(len(pairs) - 1, 0))
            known = pairs[at] == values if len(pairs) else np.zeros(len(values), bool)
            count, is_best = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            if known.any():
                count[known] = n[at[known]] * times[known]
                is_best[known] = best[at[known]] * times[known]
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[bounds]) for x in (is_best, count)]
            miss = np.flatnonzero(~known)
            items = pa.StructArray.from_arrays([pa.array(values[miss].astype(np.int64)), pa.array(times[miss])], fields=list(kinds))
            unknown = pa.ListArray.from_arrays(pa.array(np.searchsorted(miss, bounds).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(sums[0]), pa.array(sums[1]), unknown], schema.names)

    out = aligned.select(*others, "pairs", "times").mapInArrow(run, schema)
    if rest is None:
        return out.drop("uid", "unknown")
    path = scratch_path(spark, "counted")
    out.write.parquet(path)
    out = spark.read.parquet(path)
    missing = out.select("uid", F.inline("unknown"))
    more = missing.join(rest, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    out = out.drop("unknown").join(more, "uid", "left")
    for column, extra in (("n_best", "more_best"), ("count_sum", "more_sum")):
        out = out.withColumn(column, F.col(column) + F.coalesce(extra, F.lit(0)))
    return out.drop("uid", "more_best", "more_sum")
