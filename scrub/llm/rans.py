"""Static range asymmetric numeral system (rANS) over token ids, in numpy.

A table holds the frequency of every id, scaled to a power of two.  A block is coded by LANES interleaved states of 64
bits that step together, each taking every LANES-th id (fewer lanes in a short block) and giving off 32-bit words.
Blocks share a table and depend on nothing else.  A block keeps a checkpoint (all states, and how many words were read) every STEPS steps, so decoding may
begin at any of them, and the CRC-32 of its code and of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np

LANES = 2048
STEPS = 128

#: Ids of a block: four checkpoints.
BLOCK = LANES * STEPS * 4

#: Ids below this are looked up in an array, others by halving.
DENSE = 1 << 20

#: A state stays at or above 2**31 between steps and takes in or gives off 32 bits.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

_HEAD = struct.Struct("<IIIIIII")


@dataclass(frozen=True)
class Table:
    """Ids that occur (rising) and their frequencies, which add up to 2**bits."""

    ids: np.ndarray
    freq: np.ndarray
    bits: int

    @staticmethod
    def of(ids: np.ndarray) -> Table:
        """The table of these ids: shares rounded down, one at least; what is over or short goes to the frequent ones."""
        if len(ids) and ids.max() < DENSE:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            counts = counts[symbols]
        else:
            symbols, counts = np.unique(ids, return_counts=True)
        bits = max(16, min(20, len(ids).bit_length()), len(symbols).bit_length() + 2)
        freq = np.maximum(1, counts.astype(np.float64) * (1 << bits) // max(1, counts.sum())).astype(np.int64)
        if len(freq):
            freq[np.argmax(freq)] += max(0, (1 << bits) - freq.sum())
        while (over := freq.sum() - (1 << bits)) > 0:
            cut = np.minimum(freq - 1, -(-over * (freq - 1) // (freq - 1).sum()))
            before = np.cumsum(cut) - cut
            freq -= np.clip(over - before, 0, cut)
        return Table(symbols.astype(np.uint32), freq.astype(np.uint32), bits)

    @cached_property
    def starts(self) -> np.ndarray:
        return (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint64)

    @cached_property
    def wide(self) -> np.ndarray:
        return self.freq.astype(np.uint64)

    @cached_property
    def slots(self) -> np.ndarray:
        """The place in `ids` of each of the 2**bits slots."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The place in `ids` of each of these, which the table must hold."""
        if self.dense is None:
            return np.searchsorted(self.ids, ids)
        return self.dense[ids]

    @cached_property
    def dense(self) -> np.ndarray | None:
        if not len(self.ids) or self.ids[-1] >= DENSE:
            return None
        at = np.zeros(int(self.ids[-1]) + 1, np.uint32)
        at[self.ids] = np.arange(len(self.ids))
        return at

    def to_bytes(self) -> bytes:
        body = zlib.compress(np.diff(self.ids, prepend=np.uint32(0)).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())
        return struct.pack("<III", self.bits, len(self.ids), zlib.crc32(body)) + body

    @staticmethod
    def from_bytes(data: bytes) -> Table:
        bits, n, crc = struct.unpack_from("<III", data)
        if zlib.crc32(data[12:]) != crc:
            raise ValueError("the frequency table doesn't match its checksum")
        both = np.frombuffer(zlib.decompress(data[12:]), "<u4")
        return Table(np.cumsum(both[:n], dtype=np.uint32), both[n:].copy(), bits)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """The block of these ids, all of which the table must hold."""
    n = len(ids)
    lanes = 1 << min(LANES.bit_length() - 1, max(3, (n // STEPS).bit_length()))
    place = table.places(ids)
    freq, start = table.wide[place], table.starts[place]
    bits, most = np.uint64(table.bits), freq << np.uint64(63 - table.bits)
    state = np.full(lanes, LOW)
    steps = -(-n // lanes)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        f, x = freq[a:b], state[: b - a]
        full = np.flatnonzero(x >= most[a:b])
        over = x[full]
        words.append(over.astype(np.uint32))
        x[full] = over >> WORD
        q, rest = np.divmod(x, f)
        state[: b - a] = (q << bits) + rest + start[a:b]
        if step % STEPS == 0:
            marks.append(state.copy())
    words.reverse()
    marks.reverse()
    read = np.concatenate([[0], np.cumsum([len(w) for w in words])])[0:steps:STEPS].astype("<u4")
    code = np.concatenate([np.zeros(0, np.uint32), *words]).astype("<u4").tobytes()
    states = np.concatenate([np.zeros(0, np.uint64), *marks]).astype("<u8").tobytes()
    body = read.tobytes() + states + code
    return _HEAD.pack(n, lanes, STEPS, len(marks), len(code) // 4, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode(block: bytes, table: Table, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The block's ids from `begin` up to `end`, from the nearest checkpoint on; checksums are held against what is read."""
    n, lanes, every, marks, n_words, body_crc, ids_crc = _HEAD.unpack_from(block)
    if zlib.crc32(memoryview(block)[_HEAD.size :]) != body_crc:
        raise ValueError("a block's code doesn't match its checksum")
    end = n if end is None else min(end, n)
    if begin >= end:
        return np.zeros(0, np.uint32)
    read = np.frombuffer(block, "<u4", marks, _HEAD.size)
    states = np.frombuffer(block, "<u8", marks * lanes, _HEAD.size + 4 * marks).reshape(marks, lanes)
    words = np.frombuffer(block, "<u4", n_words, _HEAD.size + 4 * marks + 8 * marks * lanes)
    mark = begin // (every * lanes)
    first, last = mark * every, -(-end // lanes)
    state, at = states[mark].astype(np.uint64), int(read[mark])
    slots, freq, start = table.slots, table.wide, table.starts
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
    for step in range(first, last):
        width = min(lanes, n - step * lanes)
        x = state[:width]
        slot = x & mask
        place = slots[slot]
        x = freq[place] * (x >> bits) + slot - start[place]
        low = np.flatnonzero(x < LOW)
        x[low] = x[low] << WORD | words[at : at + len(low)]
        at += len(low)
        state[:width] = x
        out[(step - first) * lanes : (step - first) * lanes + width] = place
    ids = table.ids[out]
    if last * lanes >= n and (at != n_words or (state != LOW).any()):
        raise ValueError("a block's states don't end where they began")
    if first == 0 and last * lanes >= n and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids[begin - first * lanes : end - first * lanes]
