"""Token ids of whole texts, with the tokenizers library, as arrays."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.words import LOWER, Words, arrow_bytes, find_words

CHUNK_BYTES = 4 << 20
CACHE_PIECES = 3_000_000  # pieces whose ids a worker keeps; about 30 bytes each

# What a tokenizer file must say for its texts to be cut at white space and character classes.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF: letters but for two signs
_SIGNS = (0x97, 0xB7)
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces:
    """Ids of the pieces seen so far, by hash, in sorted arrays. Starts anew when it is full."""

    def __init__(self, dtype):
        self.dtype = dtype
        self.clear()

    def clear(self):
        self.keys = np.empty(0, np.uint64)
        self.first = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, self.dtype)

    def ids_of(self, hashes: np.ndarray, encode: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in ``ids`` of each of the sorted distinct ``hashes``; ``encode`` gets the indexes of unknown ones."""
        if len(self.keys) > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes
        new = np.flatnonzero(~known)
        if len(new):
            made = encode(new)
            size = np.array([len(x) for x in made], np.int64)
            first = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.array([i for x in made for i in x], self.dtype)])
            self.keys = np.insert(self.keys, at[new], hashes[new])
            self.first = np.insert(self.first, at[new], first)
            self.size = np.insert(self.size, at[new], size)
            at = np.searchsorted(self.keys, hashes)
        return self.first[at], self.size[at]


class Encoder:
    """Ids of the texts of an Arrow array, each followed by the end id, in the smallest unsigned type that holds the vocabulary.

    For a vocabulary whose file drops white space and cuts words by character class, every distinct piece is encoded once
    by the library and texts are put together from pieces; anything but plain letters, digits and ASCII signs is left whole to
    the library, word by word. For all other files, whole texts are encoded."""

    _kept: dict[tuple, Encoder] = {}

    @classmethod
    def of(cls, path: str, plain_special: bool = False) -> Encoder:
        """One encoder for each file in a worker."""
        if (path, plain_special) not in cls._kept:
            cls._kept[path, plain_special] = cls(path, plain_special)
        return cls._kept[path, plain_special]

    def __init__(self, path: str, plain_special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.by_piece = self._cuts_words(said)
        self.letters = _byte_letters()
        self.pieces = Pieces(self.dtype)

    @staticmethod
    def _cuts_words(said: dict) -> bool:
        normal = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            normal == NORMALIZERS
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"].get("Regex") == PIECE_PATTERN
            and not said.get("truncation")
            and said["model"]["type"] == "BPE"
            and all(t["content"].startswith("<|") and " " not in t["content"] for t in said["added_tokens"])
        )

    def _plain(self, piece: bytes) -> list[int]:
        text = piece.decode().lower().encode()
        return [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in text]))]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pieces, and whether a piece is a word left to the library."""
        data, mask = words.data, words.mask
        n = len(data)
        letter = _LETTER[data]
        latin = data == _LATIN
        follows = np.concatenate(([False], latin[:-1]))
        letter |= latin | (follows & (data >= 0x80))
        odd = (data >= 0x80) & ~letter
        odd |= data == 0x27
        odd |= follows & ((data == _SIGNS[0]) | (data == _SIGNS[1]))
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        strange = np.zeros(len(words), bool)
        if odd.any():
            at = np.searchsorted(words.starts, np.flatnonzero(odd), "right") - 1
            strange[at] = True
        kind = letter.astype(np.int8)
        kind[_DIGIT[data]] = 2
        begin = np.zeros(n, bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin &= mask
        begin[words.starts] = True
        starts = np.flatnonzero(begin)
        word = np.searchsorted(words.starts, starts, "right") - 1
        inside = strange[word] & (starts != words.starts[word])
        starts, word = starts[~inside], word[~inside]
        last = np.empty(len(starts), bool)
        if len(starts):
            last[:-1] = word[1:] != word[:-1]
            last[-1] = True
        ends = np.empty(len(starts), np.int64)
        ends[last] = words.ends[word[last]]
        inner = np.flatnonzero(~last)
        ends[inner] = starts[inner + 1]
        return starts, ends, strange[word]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their n + 1 offsets)."""
        if not self.by_piece:
            data, at = arrow_bytes(column)
            raw = data.tobytes()
            made = self._whole([raw[a:b].decode() for a, b in zip(at[:-1], at[1:])])
            sizes = np.array([len(x) + 1 for x in made], np.int64)
            flat = np.array([i for x in made for i in (*x, end)], self.dtype)
            return flat, np.concatenate(([0], np.cumsum(sizes)))
        words = find_words(column)
        starts, ends, strange = self._cut(words)
        lowered = Words(LOWER[words.data], starts, ends, words.offsets, words.mask)
        # Pieces of one word follow each other without a gap, so a piece's hash is the sum from its start to the next start.
        hashes = lowered.hashes()
        # A word left whole must not be taken for a piece of the same bytes.
        hashes[strange] ^= np.uint64(0xA5A5A5A5A5A5A5A5)
        distinct, one, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = words.data.tobytes()

        def unknown(new):
            at = one[new]
            out: list = [None] * len(new)
            left = []
            for i, (a, b, s) in enumerate(zip(starts[at].tolist(), ends[at].tolist(), strange[at].tolist())):
                if s:
                    left.append((i, raw[a:b].decode()))
                else:
                    out[i] = self._plain(raw[a:b])
            for (i, _), ids in zip(left, self._whole([text for _, text in left])):
                out[i] = ids
            return out

        first, size = self.pieces.ids_of(distinct, unknown)
        first, size = first[inverse], size[inverse]
        upto = np.concatenate(([0], np.cumsum(size)))
        flat = self.pieces.ids[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        text_ends = words.ends[words.offsets[1:] - 1] if len(words) else np.zeros(0, np.int64)
        piece_ends = np.searchsorted(starts, text_ends) if len(words) else np.zeros(len(words.offsets) - 1, np.int64)
        piece_ends = np.where(words.offsets[1:] > 0, piece_ends, 0)
        stops = upto[piece_ends]
        flat = np.insert(flat, stops, np.array(end, self.dtype))
        return flat, np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))


def token_rows(docs: DataFrame, path: str, end: int, text: str = "text", keep: list[str] | None = None, plain_special: bool = False) -> DataFrame:
    """``row`` (struct of the columns to keep), ``tie`` (hash of the text), ``n`` and ``ids`` (little-endian, two bytes an id if the vocabulary
    fits, otherwise four), the end id included. A null text is an empty one: its only id is the end id."""
    keep = list(docs.columns if keep is None else keep)
    source = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"), docs[f"`{text}`"].alias("text"), F.xxhash64(docs[f"`{text}`"]).alias("tie")
    )
    schema = source.select("row", "tie", F.lit(0).cast("long").alias("n"), F.lit(b"").alias("ids")).schema

    def run(batches):
        from turnwise.llm.words import chunks

        encoder = Encoder.of(path, plain_special)
        for batch in batches:
            for part in chunks(batch, "text", CHUNK_BYTES):
                flat, at = encoder.encode(part.column("text"), end)
                width = flat.itemsize
                ids = pa.Array.from_buffers(
                    pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))]
                )
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("tie"), pa.array(np.diff(at)), ids], ["row", "tie", "n", "ids"])

    return source.mapInArrow(run, schema)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
