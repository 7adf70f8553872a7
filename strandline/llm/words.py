"""Words of a batch of texts as 64-bit hashes, for all texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers of it never vanish


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each byte: 0 between words, else its value with A-Z lowered. Bytes beyond ASCII belong to words."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        if byte >= 128 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 128 else byte
    return table


_powers = np.ones(1, np.uint64)


def powers(count: int) -> np.ndarray:
    global _powers
    if len(_powers) < count:
        made = np.full(max(count, 4096), FACTOR, np.uint64)
        made[0] = 1
        _powers = np.cumprod(made)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and where each value begins and the last ends."""
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array, *stems: int) -> tuple[np.ndarray, ...]:
    """Of every word in the column, in order: its hash, the row it is in, and its first and end byte in that row.

    For each of ``stems``, longest first, also the hash of its first so many bytes.
    """
    data, offsets = flat_bytes(column)
    low = _letters()[data]
    inside = low > 0
    before = np.r_[False, inside[:-1]]
    first = offsets[:-1]
    before[first[first < len(data)]] = False  # a word never goes over the end of a text
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return (none.astype(np.uint64), none, none, none, *([none.astype(np.uint64)] * len(stems)))
    places = np.flatnonzero(inside)
    begin = np.searchsorted(places, starts)
    lengths = np.diff(np.r_[begin, len(places)])
    within = np.arange(len(places)) - np.repeat(begin, lengths)
    spread = low[places].astype(np.uint64) * powers(int(lengths.max()))[within]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    found = [mix(np.add.reduceat(spread, begin)), rows, starts - offsets[rows], starts + lengths - offsets[rows]]
    for stem in stems:
        spread[within >= stem] = 0
        found.append(mix(np.add.reduceat(spread, begin)))
    return tuple(found)


def hash_of(word: str) -> int:
    """The hash that ``word_hashes`` gives a single word."""
    return int(word_hashes(pa.array([word.encode()], pa.binary()))[0][0])
