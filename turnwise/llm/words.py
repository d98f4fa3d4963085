"""Words of Arrow text columns as numpy arrays: where they lie, 64-bit hashes, hashes of runs of words.

Tasks get whole texts in Arrow batches. A batch is cut into chunks of about ``CHUNK_BYTES`` (a longer text is a chunk of its
own), and each chunk is scanned with array operations on its bytes, so memory follows the chunk, not the batch. Words end at
ASCII characters only, which never occur inside a longer UTF-8 sequence; working on bytes is therefore exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 14

# Words end at the space and at U+0009..U+000D.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = True
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    ALNUM[ord(_low) : ord(_high) + 1] = True
# Maps A-Z to a-z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE ** i`` and ``_BASE ** -i`` modulo 2**64 for i below a size of at least n; the usual size is kept."""
    size = 2 * CHUNK_BYTES if n <= 2 * CHUNK_BYTES else n
    if size in _powers:
        return _powers[size]

    def row(base):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    made = row(_BASE), row(_BASE_INVERSE)
    if size == 2 * CHUNK_BYTES:
        _powers[size] = made
    return made


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result depends on all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair in order."""
    x = left * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(35)
    x += right
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x


@dataclass
class Words:
    """Words of the texts of a chunk, one after another."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past its last byte
    offsets: np.ndarray  # text i has the words offsets[i] to offsets[i + 1]
    mask: np.ndarray  # bytes that belong to words

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.offsets[1:], self.counts) - np.arange(len(self))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.empty(0, np.uint64)
        up, down = powers(len(self.data))
        values = _BYTE[self.data]
        values *= up[: len(self.data)]
        values[~self.mask] = 0
        out = np.add.reduceat(values, self.starts)
        out *= down[self.starts]
        return scramble(out)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and their n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def find_words(column: pa.Array, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    data, at = arrow_bytes(column)
    if lower:
        data = LOWER[data]
    mask = table[data]
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[at] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | first[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at), mask)


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each, at least one row and at most ``CHUNK_ROWS``."""
    _, at = arrow_bytes(batch.column(text))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        end = min(end, begin + CHUNK_ROWS, n)
        yield batch.slice(begin, end - begin)
        begin = end


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of every run of ``length`` consecutive values, by doubling; entry i is for the run that begins at i."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, span = None, 0, hashes, 1
    while True:
        if length & span:
            part = power[done : done + n]
            out = part if out is None else join_hash(out, part)
            done += span
        if done == length:
            return out
        power = join_hash(power[:-span], power[span:])
        span *= 2


def second_lane(hashes: np.ndarray) -> np.ndarray:
    """Another hash of the same words, so that two lanes make 128 bits."""
    return scramble(hashes ^ np.uint64(0x94D049BB133111EB))


def slide_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_list(words: Words, text: int) -> list[bytes]:
    data = words.data.tobytes()
    begin, end = words.offsets[text], words.offsets[text + 1]
    return [data[s:e] for s, e in zip(words.starts[begin:end], words.ends[begin:end])]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space: their bytes are gathered by one index."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    last = np.cumsum(lengths) - 1
    at[last] = 0
    out = data[at]
    out[last] = 0x20
    return out[:-1].tobytes()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
