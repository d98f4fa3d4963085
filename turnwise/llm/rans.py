"""Range asymmetric numeral systems with a static table, in numpy: many interleaved lanes, many blocks at once.

A block holds up to ``BLOCK`` ids. Id i of a block goes to lane ``i % LANES`` at step ``i // LANES``. All lanes of a block share
one stream of 32-bit words. Every ``STRIDE`` steps a checkpoint keeps the lanes' states and the place in the stream, so that
the parts of a block decode in parallel; blocks are independent anyway. The layout, all little-endian:

    magic 'RANS', version u16, lanes u16, ids u32, steps between checkpoints u32, checkpoints u32, words u32, crc32 u32
    place in the stream of each checkpoint, u32
    states of each checkpoint, u64 for each lane
    words, u32

The checksum is over the block's ids as unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
LANES = 32
BLOCK = 1 << 14
STRIDE = 128
MAGIC, VERSION = b"RANS", 1
_HEAD = struct.Struct("<4sHHIIIII")
_LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
_WORD = np.uint64(32)
_BITS = np.uint64(SCALE_BITS)
_RENORM = np.uint64(63 - SCALE_BITS)


@dataclass
class Table:
    """Frequencies that add up to ``2**SCALE_BITS``; an id that never occurs has none."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = np.asarray(self.freq, np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.common = int(np.argmax(self.freq))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Every id that occurs gets one slot, the others are dealt in proportion, and what rounding leaves goes to the
        most frequent id. An empty corpus has the table of id 0."""
        counts = np.asarray(counts, np.float64)
        if not counts.sum():
            counts = np.ones(1)
        seen = counts > 0
        if seen.sum() > 1 << SCALE_BITS:
            raise ValueError(f"{seen.sum()} distinct ids do not fit a table of {1 << SCALE_BITS} slots")
        spare = (1 << SCALE_BITS) - int(seen.sum())
        freq = np.where(seen, 1 + np.floor(spare * (counts / counts.sum())), 0).astype(np.int64)
        freq[np.argmax(counts)] += (1 << SCALE_BITS) - freq.sum()
        return cls(freq)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks of ``BLOCK`` ids, the last one shorter. Lanes are filled up with the most frequent id."""
    ids = np.asarray(ids, np.uint32)
    if not len(ids):
        return []
    if ids.max() >= len(table.freq) or not table.freq[ids].all():
        raise ValueError("an id is not in the frequency table")
    out = []
    full = len(ids) // BLOCK
    if full:
        out += _encode(ids[: full * BLOCK].reshape(full, BLOCK), BLOCK, table)
    if len(ids) % BLOCK:
        rest = ids[full * BLOCK :]
        steps = -(-len(rest) // LANES)
        padded = np.full((1, steps * LANES), table.common, np.uint32)
        padded[0, : len(rest)] = rest
        out += _encode(padded, len(rest), table)
    return out


def _encode(ids: np.ndarray, n_ids: int, table: Table) -> list[bytes]:
    blocks, steps = len(ids), ids.shape[1] // LANES
    lanes = ids.reshape(blocks, steps, LANES)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    room = steps * LANES
    words = np.zeros((blocks, room), np.uint32)
    place = np.full(blocks, room, np.int64)
    n_marks = -(-steps // STRIDE)
    marks = np.zeros((blocks, n_marks, LANES), np.uint64)
    places = np.zeros((blocks, n_marks), np.int64)
    for t in range(steps - 1, -1, -1):
        symbols = lanes[:, t]
        freq = table.freq[symbols]
        full = state >= (freq << _RENORM)
        row, lane = np.nonzero(full)
        if len(row):
            count = full.sum(axis=1)
            place -= count
            rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            words[row, place[row] + rank] = state[row, lane].astype(np.uint32)
            state[row, lane] >>= _WORD
        state = ((state // freq) << _BITS) + state % freq + table.start[symbols]
        if t % STRIDE == 0:
            marks[:, t // STRIDE] = state
            places[:, t // STRIDE] = place
    out = []
    for b in range(blocks):
        stream = words[b, place[b] :]
        crc = zlib.crc32(ids[b, :n_ids].astype("<u4").tobytes())
        head = _HEAD.pack(MAGIC, VERSION, LANES, n_ids, STRIDE, n_marks, len(stream), crc)
        out.append(head + (places[b] - place[b]).astype("<u4").tobytes() + marks[b].astype("<u8").tobytes() + stream.astype("<u4").tobytes())
    return out


def decode_blocks(blocks: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of each block. A damaged block raises."""
    heads, segments = [], []
    streams, base = [], 0
    for number, block in enumerate(blocks):
        magic, version, lanes, n_ids, stride, n_marks, n_words, crc = _HEAD.unpack_from(block)
        if (magic, version, lanes) != (MAGIC, VERSION, LANES):
            raise ValueError("not a block of this format")
        at = _HEAD.size
        places = np.frombuffer(block, "<u4", n_marks, at).astype(np.int64)
        states = np.frombuffer(block, "<u8", n_marks * lanes, at + 4 * n_marks).reshape(n_marks, lanes)
        streams.append(np.frombuffer(block, "<u4", n_words, at + 4 * n_marks + 8 * n_marks * lanes))
        steps = -(-n_ids // lanes)
        heads.append((n_ids, crc, steps))
        for k in range(n_marks):
            segments.append((number, k * stride, min(steps, (k + 1) * stride) - k * stride, base + places[k], states[k]))
        base += n_words
    if not segments:
        return []
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    # Longer segments first, so that those still running are always a prefix.
    segments.sort(key=lambda s: -s[2])
    length = np.array([s[2] for s in segments])
    place = np.array([s[3] for s in segments])
    state = np.array([s[4] for s in segments], np.uint64)
    ids = np.zeros((len(segments), int(length[0]), LANES), np.uint32)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    for t in range(int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))  # segments longer than t
        x = state[:live]
        slot = x & mask
        symbols = table.symbol[slot.astype(np.int64)]
        ids[:live, t] = symbols
        x = table.freq[symbols] * (x >> _BITS) + slot - table.start[symbols]
        low = x < _LOW
        row, lane = np.nonzero(low)
        if len(row):
            count = low.sum(axis=1)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            x[row, lane] = (x[row, lane] << _WORD) | stream[place[row] + rank]
            place[:live] += count
        state[:live] = x
    parts: list[list] = [[] for _ in blocks]
    for segment, values in zip(segments, ids):
        parts[segment[0]].append((segment[1], values[: segment[2]].reshape(-1)))
    out = []
    for (n_ids, crc, _), found in zip(heads, parts):
        whole = np.concatenate([v for _, v in sorted(found, key=lambda p: p[0])])[:n_ids]
        if zlib.crc32(whole.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block does not match")
        out.append(whole)
    return out


# CRC-32 of joined data from the parts' checksums: polynomials modulo the CRC's own, lowest power in the highest bit.
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return product


_SHIFT = [1 << 23]  # x ** 8: one byte; then its squares
for _ in range(63):
    _SHIFT.append(_times(_SHIFT[-1], _SHIFT[-1]))


def join_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two pieces of data, from the checksum of each and the length of the second."""
    power, bit = 1 << 31, 0
    while second_bytes >> bit:
        if second_bytes >> bit & 1:
            power = _times(power, _SHIFT[bit])
        bit += 1
    return _times(power, first) ^ second
