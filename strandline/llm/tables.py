"""Which hashes are frequent: counters of bounded size, told to all tasks as bits.

Tasks count their hashes by leading bits and send on what they counted, three bytes a counter where counts are small;
the sums are made behind a shuffle by ranges of counters, and one bit of each comes back. A hash that is there often
enough always has its bit. Others may share it, the more the fuller the table is, so it decides on cost only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.frames import map_arrow

PART_BITS = 15  # counters in one row
LEAST_BITS, MOST_BITS = 20, 27  # 16 MB at most
BUCKETS_AT_ONCE = 4 << 20
TASKS = 64


def bits_for(hashes: int) -> int:
    """Bits of a table for so many hashes: some sixteen counters each, as long as that is within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * hashes).bit_length()))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.uint32)


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash has its bit."""
    place = _bucket(hashes, len(table).bit_length() + 2)
    return table[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def frequent(
    source: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int, bits: int, at_once: int = BUCKETS_AT_ONCE
) -> np.ndarray:
    """The table, of 2**bits bits, of the hashes that ``hashes`` makes of ``source`` at least ``least`` times."""
    small = np.min_scalar_type(least)  # a task's count is cut at the least one, which changes no answer
    size = 1 << PART_BITS

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets, seen = np.unique(np.concatenate(held), return_counts=True)
        seen = np.minimum(seen, least).astype(small)
        part, place = (buckets >> PART_BITS).astype(np.int32), (buckets & (size - 1)).astype(np.uint16)
        firsts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[firsts[1:], len(part)]
        data = [place[a:b].tobytes() + seen[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[firsts]), pa.array(data, pa.binary())], ["part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in hashes(batches):
            held.append(_bucket(found, bits))
            n += len(found)
            if n > at_once:
                yield told(held)
                held, n = [], 0
        if n:
            yield told(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                entries = len(data) // (2 + small.itemsize)
                counters = total.setdefault(part, np.zeros(size, np.int64))
                counters[np.frombuffer(data, np.uint16, entries)] += np.frombuffer(data, small, entries, 2 * entries)
        marks = [np.packbits(c >= least, bitorder="little").tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(marks, pa.binary())], ["part", "bits"])

    counted = map_arrow(source, count, "part int, data binary").repartition(TASKS, "part")
    table = np.zeros((1 << bits) // 8, np.uint8)
    # At most 2**(bits - PART_BITS) rows of 4 kB.
    for row in map_arrow(counted, add, "part int, bits binary").collect():
        table[row["part"] * size // 8 : (row["part"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return table
