"""Sets of word shingles of texts, their fingerprints and MinHash values, as numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from turnwise.llm.words import CHUNK_ROWS, Words, find_words, join_hash, run_hashes, scramble

WIDTH = 5
_BITS = np.uint64(50)  # of a shingle's hash; the others number the texts of a chunk while they are sorted
assert CHUNK_ROWS <= 1 << 14


@dataclass
class Shingles:
    """Distinct shingle hashes of a chunk's texts, sorted within each; text i has offsets[i] to offsets[i + 1]."""

    values: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def shingles_of(words: Words, width: int = WIDTH) -> Shingles:
    """A text of fewer words than ``width``, but not none, has one shingle of all of them."""
    hashes, counts, text = words.hashes(), words.counts, words.text_of()
    runs = run_hashes(hashes, width)
    fits = np.flatnonzero(words.room()[: len(runs)] >= width)
    values, owner = runs[fits], text[fits]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for doc in short:
            value = hashes[words.offsets[doc] : words.offsets[doc] + 1]
            for i in range(1, counts[doc]):
                value = join_hash(value, hashes[words.offsets[doc] + i : words.offsets[doc] + i + 1])
            extra.append(scramble(value ^ np.uint64(counts[doc]))[0])
        values, owner = np.concatenate([values, np.array(extra, np.uint64)]), np.concatenate([owner, short])
    keys = np.sort((owner.astype(np.uint64) << _BITS) | (values >> (np.uint64(64) - _BITS)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    values, owner = keys & ((np.uint64(1) << _BITS) - np.uint64(1)), (keys >> _BITS).astype(np.int64)
    return Shingles(values, np.searchsorted(owner, np.arange(len(counts) + 1)))


def text_shingles(column, width: int = WIDTH) -> Shingles:
    return shingles_of(find_words(column), width)


def segment_reduce(op, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``op.reduceat`` over the segments; empty ones get ``empty``."""
    counts = np.diff(offsets)
    out = np.full(len(counts), empty, values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = op.reduceat(values, offsets[full])
    return out


def fingerprints(shingles: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set: sums of two mixings of its values."""
    one = segment_reduce(np.add, scramble(shingles.values ^ np.uint64(0x2545F4914F6CDD1D)), shingles.offsets, 0)
    two = segment_reduce(np.add, scramble(shingles.values + np.uint64(0x9E3779B97F4A7C15)), shingles.offsets, 0)
    return scramble(one), scramble(two)


def minhash(shingles: Shingles, n: int) -> np.ndarray:
    """``n`` MinHash values of each set, 32 bits each; an empty set has zeros."""
    multipliers = np.random.default_rng(97).integers(1, 2**64, n, dtype=np.uint64) | np.uint64(1)
    out = np.zeros((len(shingles.counts), n), np.uint32)
    for i, m in enumerate(multipliers):
        mixed = shingles.values * m
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9FB21C651E98DF25)
        out[:, i] = segment_reduce(np.minimum, (mixed >> np.uint64(32)).astype(np.uint32), shingles.offsets, 0)
    return out
