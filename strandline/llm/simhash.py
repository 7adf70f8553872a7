"""Near-duplicate documents by SimHash, linked through meet-in-the-middle balls.

Two fingerprints at most 2r bits apart have a common variant within r bits of both. Every distinct fingerprint
emits all its variants within r = 2 bits, equal variants meet, and fingerprints that share one are linked after a
check of their distance. A variant is shuffled by its leading bits only: a row stands for all variants of one
fingerprint with the same leading bits, and the rest of the ball is expanded behind the shuffle, block by block.
That moves 79 rows per fingerprint instead of 2,081. Leading parts that many fingerprints are near to are cut by
further bits, so that no key's share is unbounded; which are, follows from at most 4,096 counts.

Within a block each fingerprint is tied to the least one it is linked with there, so groups never become pairs.

Edge cases: null and empty texts, and texts of white space alone, have fingerprint zero and are linked like any
other; texts with fewer words than a shingle are one shingle; repeated rows are in one component; a null identifier
plays no part in a component's least unless nothing else is there; texts of any length are
read whole; an empty table gives an empty table; other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.frames import map_arrow, map_texts
from strandline.llm.places import placed, without
from strandline.scratch import stored

LEAD = 12  # leading bits that a variant is shuffled by
FLIPS = 2  # half the radius
# Rows of one leading part beyond which it is cut by 8 or 24 further bits. Only cost depends on it.
ROWS_PER_KEY = 1 << 18
# Variants expanded at once in a task.
VARIANTS_AT_ONCE = 1 << 21
BITS = np.array([[byte >> i & 1 for i in range(8)] for byte in range(256)], np.int64)


def shingles(data: bytes, words: int) -> list[bytes]:
    """Runs of ``words`` words, joined by spaces; a text with fewer is one run, one without words has none."""
    found = data.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    joined = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    return [joined[s:e] for s, e in zip(starts, (e - 1 for e in starts[words:]), strict=False)]


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """A hash of each of the text's shingles, repeats included."""
    parts = shingles(data, words)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))


def fingerprint(data: bytes, words: int) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    return fingerprint_of(shingle_hashes(data, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text with such shingles; zero without any."""
    if not len(hashes):
        return 0
    places = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a long) of every row."""
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))

    def work(batch: pa.RecordBatch) -> list:
        values = [fingerprint(d, words) for d in batch.column("data").to_pylist()]
        return [batch.column("id"), pa.array(values, pa.int64())]

    return map_texts(source, "data", f"id {source.schema['id'].dataType.simpleString()}, fp bigint", work)


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` of ``bits`` bits, fewest first."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def _further(near: np.ndarray, rows_per_key: int) -> np.ndarray:
    """Further leading bits for each leading part, by the rows that come near it."""
    return np.select([near <= rows_per_key, near <= rows_per_key * 6], [0, 8], 24)


def emit(fps: DataFrame, rows_per_key: int) -> DataFrame:
    """A row per fingerprint and leading part within reach: ``key``, ``spent`` (flips used), ``fp``."""
    counted = fps.groupBy(F.shiftrightunsigned("fp", 64 - LEAD).alias("lead")).count().collect()  # at most 4,096 rows
    own = np.zeros(1 << LEAD, np.int64)
    own[[r["lead"] for r in counted]] = [r["count"] for r in counted]
    masks = flips(LEAD, FLIPS)
    near = sum(own[np.arange(1 << LEAD) ^ int(m)] for m in masks)
    depth = _further(near, rows_per_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            lead = fp >> np.uint64(64 - LEAD)
            for mask in masks:
                key, used = lead ^ mask, int(mask).bit_count()
                deep = depth[key.astype(np.int64)]
                for bits in np.unique(deep).tolist():
                    some = deep == bits
                    rest = fp[some] >> np.uint64(64 - LEAD - bits) & np.uint64((1 << bits) - 1)
                    for more in flips(bits, FLIPS - used):
                        # The key: how deep, then the leading bits of the variants meant.
                        full = np.uint64(bits << 48) | key[some] << np.uint64(bits) | (rest ^ more)
                        spent = np.full(len(full), used + int(more).bit_count(), np.int8)
                        yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(spent), pa.array(fp[some].view(np.int64))], ["key", "spent", "fp"])

    return map_arrow(fps.select("fp"), run, "key bigint, spent tinyint, fp bigint")


def _expanded(key: np.ndarray, spent: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All variants of the rows, and the row of each."""
    values, owners = [], []
    bits = (key >> np.uint64(48)).astype(np.int64)
    lead = key & np.uint64((1 << 48) - 1)
    for depth in np.unique(bits).tolist():
        low = 64 - LEAD - depth
        for used in range(FLIPS + 1):
            rows = np.flatnonzero((bits == depth) & (spent == used))
            if len(rows):
                base = lead[rows] << np.uint64(low) | fp[rows] & np.uint64((1 << low) - 1)
                masks = flips(low, FLIPS - used)
                values.append((base[:, None] ^ masks).ravel())
                owners.append(np.repeat(rows, len(masks)))
    return np.concatenate(values), np.concatenate(owners)


def links(key: np.ndarray, spent: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that meet in a variant, each tied to the least of those it is linked with in this block."""
    values, owners = _expanded(key, spent, fp)
    ordered = np.sort(values)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(met):
        return fp[:0], fp[:0]
    place = np.minimum(np.searchsorted(met, values), len(met) - 1)
    hit = met[place] == values
    place, owner = place[hit], owners[hit]
    names, node = np.unique(fp[owner], return_inverse=True)
    order = np.argsort(place, kind="stable")
    place, node = place[order], node[order]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    group = np.cumsum(np.r_[False, place[1:] != place[:-1]])
    first = np.minimum.reduceat(node, starts)
    close = np.bitwise_count(names[node] ^ names[first[group]]) <= 2 * FLIPS  # holds for all that share a variant
    group, node = group[close], node[close]
    label = np.arange(len(names))
    while True:
        least = np.full(len(starts), len(names))
        np.minimum.at(least, group, label[node])
        after = label.copy()
        np.minimum.at(after, node, least[group])
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    tied = label != np.arange(len(names))
    return names[tied], names[label[tied]]


def near_pairs(fps: DataFrame, rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """Links ``u``, ``v`` whose components are those of all pairs at most 4 bits apart; ``fps``: distinct ``fp``."""
    rows = emit(fps, rows_per_key).repartition("key").sortWithinPartitions("key")
    sizes = {(d, u): len(flips(64 - LEAD - d, FLIPS - u)) for d in (0, 8, 24) for u in range(FLIPS + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        room = 0

        def block(rows: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            key, spent, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            if len(key):
                u, v = links(key.view(np.uint64), spent, fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            columns = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "spent", "fp"))
            key, spent = columns[0], columns[1]
            weight = np.zeros(len(key), np.int64)
            for (depth, used), size in sizes.items():
                weight[(key >> 48 == depth) & (spent == used)] = size
            # A block ends where the key changes, once it has enough variants.
            total = np.cumsum(weight)
            new_key = np.r_[not held or held[-1][0][-1] != key[0], key[1:] != key[:-1]]
            start = 0
            while start < len(key):
                base = total[start - 1] if start else 0
                ends = np.flatnonzero(new_key & (total - weight - base + room >= VARIANTS_AT_ONCE))
                ends = ends[ends >= start] if held else ends[ends > start]
                stop = int(ends[0]) if len(ends) else len(key)
                if stop > start:
                    held.append(tuple(c[start:stop] for c in columns))
                    room += int(total[stop - 1] - base)
                if len(ends):
                    yield from block(held)
                    held, room = [], 0
                start = stop
        if held:
            yield from block(held)

    return map_arrow(rows, run, "u bigint, v bigint")


def simhash_groups(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``fp`` and ``component_id`` (the least identifier reachable) of every row."""
    rows = stored(fingerprints(docs, words, id_column, text), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    labels = stored(connected_components(near_pairs(distinct)), "labels").withColumnRenamed("node", "fp")
    linked = distinct.join(labels, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = linked.join(least, "component").select("fp", "component_id")
    return rows.join(of_print, "fp", "left").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, read from files, with one document of each component: the least identifier, first by place."""
    named = placed(docs).select(F.struct(F.col(f"`{id_column}`").alias("id"), F.col("_place").alias("place")).alias("who"), F.col(f"`{text}`").alias("text"))
    groups = simhash_groups(named, words, "who", "text")
    return without(docs, groups.filter("id != component_id").select("id.place"))
