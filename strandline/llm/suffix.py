"""Removal of repeated byte strings of a fixed length, by suffix arrays over shards of what may repeat.

Every window of LENGTH bytes is led by the least hash among its 32-byte grams (the last such gram), so equal windows
have the same leading gram in the same place. A gram that leads windows in one place only leads no repeated window.
For the others, the bytes around each place (its windows from first to last: the context) go to the gram's shard.
Equal contexts are kept once, with their count; where a gram has different contexts, the shard's suffix array, built
by induced sorting, and its permuted common prefixes tell which windows start elsewhere too. The windows' places are
then joined back and their bytes removed.

A gram whose different contexts exceed SHARD_BYTES (one passage in a large part of all documents) is not gathered:
its windows are counted by two 64-bit hashes of their bytes, in any number of tasks, with the same result.

Which grams may repeat is decided by a bit table of bounded size; it only lets further contexts through.

Edge cases: null and empty texts, and texts shorter than LENGTH, lose nothing; copies of a longer text lose all;
repeated rows are copies; overlapping and self-overlapping strings count; strings may begin or end inside a
character, so what is kept is bytes; texts of any length are searched whole; an empty table gives an empty table;
other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.frames import map_arrow, map_texts
from strandline.llm.places import PLACE, placed
from strandline.llm.sais import common_prefixes, suffix_array
from strandline.llm.words import FACTOR, flat_bytes, mix
from strandline.scratch import stored

LENGTH = 400
GRAM = 32
# Bytes that one suffix array is built over, and of different contexts of one gram beyond which they are counted.
ARRAY_BYTES = 1 << 20
SHARD_BYTES = 4 << 20
LEAST_BITS, MOST_BITS = 20, 27  # of the bit table: 16 MB at most


@lru_cache(maxsize=4)
def _scales(factor: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor, and of its inverse modulo 2**64."""
    both = []
    for base in (factor, pow(factor, -1, 1 << 64)):
        power = np.full(count, base, np.uint64)
        power[0] = 1
        both.append(np.cumprod(power))
    return tuple(both)


def _window_hashes(data: np.ndarray, length: int, factor: int = int(FACTOR)) -> np.ndarray:
    """A hash of each run of ``length`` bytes, that depends on these bytes alone."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    power, inverse = _scales(factor, 1 << len(data).bit_length())
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    return mix((prefix[length:] - prefix[:-length]) * inverse[: len(data) - length + 1])


def leaders(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Leading grams of all windows inside the texts: hash, text, first and last window, and the gram itself.

    All places are within the text.
    """
    count = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none.astype(np.uint64), none, none, none, none
    grams = _window_hashes(data, GRAM)
    reach = length - GRAM + 1
    # The hash, and below it the place from the end, so that of equal hashes the last one is least.
    place = np.arange(len(grams)).astype(np.uint64)
    key = grams >> np.uint64(24) << np.uint64(24) | (np.uint64((1 << 24) - 1) - place)
    # Least of each window: the end of one block and the beginning of the next.
    padded = np.full(-(-len(key) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, reach)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(backward[:count], forward[reach - 1 : reach - 1 + count])
    lead = np.int64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    valid = np.arange(count) + length <= offsets[text + 1]
    windows = np.flatnonzero(valid)
    if not len(windows):
        return none.astype(np.uint64), none, none, none, none
    lead, text = lead[windows], text[windows]
    fresh = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[fresh[1:], len(windows)] - 1
    own = text[fresh]
    return grams[lead[fresh]], own, windows[fresh] - offsets[own], windows[last] - offsets[own], lead[fresh] - offsets[own]


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Texts of a batch end to end; a text of over 8 MB in overlapping parts. Yields bytes, offsets, first row, shift."""
    most = 8 << 20
    data, offsets = flat_bytes(batch.column("data"))
    if len(data) <= most:
        yield data, offsets, 0, 0
        return
    for row in range(batch.num_rows):
        text = data[offsets[row] : offsets[row + 1]]
        for shift in range(0, max(1, len(text) - length + 1), most):
            part = text[shift : shift + most + length - 1]
            yield part, np.array([0, len(part)]), row, shift


def _source(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return placed(docs).select(F.col(f"`{id_column}`").alias("id"), F.col("_place").alias("place"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"))


def _repeated_grams(source: DataFrame, length: int) -> DataFrame:
    """``gram`` of those that lead in more than one place."""

    def work(batch: pa.RecordBatch) -> list:
        found = [leaders(data, offsets, length)[0] for data, offsets, _, _ in _blocks(batch, length)]
        return [pa.array(np.concatenate(found).view(np.int64))]

    return map_texts(source.select("data"), "data", "gram bigint", work).groupBy("gram").count().filter("count > 1").select("gram")


def _probes(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return (grams >> shift).astype(np.int64), (grams * FACTOR >> shift).astype(np.int64)


def _bit_table(grams: DataFrame) -> tuple[np.ndarray, int]:
    count = grams.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_probes(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(both))], ["bit"])

    parts = (
        map_arrow(grams, run, "bit bigint")
        .groupBy(F.shiftright("bit", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
        .collect()
    )
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts:
        table[row["part"] * 4096 : row["part"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
    return table, bits


def _contexts(source: DataFrame, table: np.ndarray, bits: int, length: int) -> DataFrame:
    """``gram``, ``place``, ``first`` (window), the gram's place in the context, two hashes of that and its bytes, where the table has the gram.

    Of equal contexts in a piece of the input only the first one carries the bytes.
    """
    shared = source.sparkSession.sparkContext.broadcast(table)

    def work(batch: pa.RecordBatch) -> list | None:
        grams, rows, firsts, places, digests, contexts = [], [], [], [], [], []
        seen: set[bytes] = set()
        for data, offsets, row, shift in _blocks(batch, length):
            gram, text, first, last, place = leaders(data, offsets, length)
            for probe in (0, 1):
                at = _probes(gram, bits)[probe]
                good = shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                gram, text, first, last, place = (x[good] for x in (gram, text, first, last, place))
            grams.append(gram)
            places.append(place - first)
            rows.append(text + row)
            firsts.append(first + shift)
            raw = memoryview(data.tobytes())
            begin = offsets[text] + first
            for a, b in zip(begin.tolist(), (begin + (last - first) + length).tolist(), strict=True):
                digest = xxhash.xxh3_128_digest(raw[a:b])
                digests.append(digest)
                contexts.append(None if digest in seen else bytes(raw[a:b]))
                seen.add(digest)
        if not contexts:
            return None
        hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        return [
            pa.array(np.concatenate(grams).view(np.int64)),
            batch.column("place").take(pa.array(np.concatenate(rows))),
            pa.array(np.concatenate(firsts)),
            pa.array(np.concatenate(places)),
            pa.array(hashes[:, 0].copy()),
            pa.array(hashes[:, 1].copy()),
            pa.array(contexts, pa.binary()),
        ]

    schema = f"gram bigint, place {PLACE}, first bigint, at bigint, h1 bigint, h2 bigint, context binary"
    return map_texts(source.select("place", "data"), "data", schema, work)


def common_start(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def extents(parts: list[bytes]) -> list[int]:
    """For each part, the longest prefix that it shares with another one; neighbours in order tell."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    longest = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        same = common_start(parts[i], parts[j])
        longest[i], longest[j] = max(longest[i], same), max(longest[j], same)
    return longest


def cut(contexts: list[bytes], places: list[int]) -> list[tuple[int, int]]:
    """Of contexts of one gram, the stretch of each around the gram that some other context shares on either side.

    Equal windows have the gram in the same place, so no window beyond the stretch starts in another context too.
    """
    right = extents([c[p:] for c, p in zip(contexts, places, strict=True)])
    left = extents([c[:p][::-1] for c, p in zip(contexts, places, strict=True)])
    return [(p - a, p + b) for p, a, b in zip(places, left, right, strict=True)]


def repeated_windows(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The runs of windows (first, last) of each context that start elsewhere too."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    s = np.frombuffer(b"\0".join(contexts), np.uint8).astype(np.int64) + 2
    s[starts[1:] - 1] = 1
    s = np.r_[s, 0]
    before, prefix = common_prefixes(s, suffix_array(s, 258))
    again = prefix >= length
    again[before[again]] = True
    out = []
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        edge = np.flatnonzero(np.diff(np.r_[False, again[start : start + size - length + 1], False]))
        out.append(list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)))
    return out


RUNS = "array<struct<first:bigint,last:bigint>>"


def _by_suffix_array(distinct: DataFrame, length: int) -> DataFrame:
    """``gram``, ``h1``, ``h2``, ``runs``: grams' contexts, whole grams together, many to an array.

    All windows of a context that came more than once repeat. What its neighbours cannot share is cut off first, and
    a context that is left with less than a window repeats none.
    """
    rows = distinct.select("gram", "h1", "h2", "copies", "at", "context").repartition("gram").sortWithinPartitions("gram")
    run_list = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []  # the rows of one gram
        held: list[tuple[tuple, int, bytes]] = []  # row, where the cut begins, bytes
        whole: list[tuple] = []
        size = 0

        def close() -> int:
            added = 0
            for row, (low, high) in zip(own, cut([r[5] for r in own], [r[4] for r in own]), strict=True):
                if row[3] > 1:
                    whole.append(row)
                if high - low >= length:
                    held.append((row, low, row[5][low:high]))
                    added += high - low
            own.clear()
            return added

        def finish() -> pa.RecordBatch:
            found = repeated_windows([h[2] for h in held], length) if held else []
            out = [(h[0], [(a + h[1], b + h[1]) for a, b in runs]) for h, runs in zip(held, found, strict=True) if h[0][3] == 1]
            out += [(row, [(0, len(row[5]) - length)]) for row in whole]
            held.clear()
            whole.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array([row[k] for row, _ in out], pa.int64()) for k in range(3)), pa.array([[{"first": a, "last": b} for a, b in runs] for _, runs in out], run_list)],
                ["gram", "h1", "h2", "runs"],
            )

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if own and row[0] != own[0][0]:
                    size += close()
                    if size >= ARRAY_BYTES:
                        yield finish()
                        size = 0
                own.append(row)
        close()
        yield finish()

    return map_arrow(rows, run, f"gram bigint, h1 bigint, h2 bigint, runs {RUNS}")


def _by_count(distinct: DataFrame, length: int) -> DataFrame:
    """The same for grams with too many contexts to gather: every window is counted by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = 0xC2B2AE3D27D4EB4F
        for batch in batches:
            for i, context in enumerate(batch.column("context").to_pylist()):
                data = np.frombuffer(context, np.uint8)
                one, two = _window_hashes(data, length), _window_hashes(data, length, other)
                pick = pa.array(np.full(len(one), i))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pick) for c in ("gram", "h1", "h2", "copies")), pa.array(np.arange(len(one))), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["gram", "h1", "h2", "copies", "at", "w1", "w2"],
                )

    schema = "gram bigint, h1 bigint, h2 bigint, copies bigint, at bigint, w1 bigint, w2 bigint"
    windows = stored(map_arrow(distinct.select("gram", "h1", "h2", "copies", "context"), run, schema), "windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("seen")).filter("seen > 1").select("w1", "w2")
    runs = windows.join(again, ["w1", "w2"]).groupBy("gram", "h1", "h2")
    return runs.agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("runs"))


def repeated_runs(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``place``, ``first``, ``last``: runs of windows of each document that start elsewhere too."""
    source = _source(docs, id_column, text)
    table, bits = _bit_table(stored(_repeated_grams(source, length), "grams"))
    contexts = stored(_contexts(source, table, bits, length), "contexts")
    distinct = contexts.groupBy("gram", "h1", "h2").agg(
        F.count(F.lit(1)).alias("copies"), F.first("at").alias("at"), F.first("context", ignorenulls=True).alias("context")
    )
    distinct = stored(distinct, "distinct")
    shards = distinct.groupBy("gram").agg(
        F.sum(F.length("context")).alias("bytes"), F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("places")
    ).filter("places > 1")
    shards = stored(shards, "shards")
    # One context only, in several places: all of its windows repeat.
    alone = distinct.join(shards.filter("kinds = 1").select("gram"), "gram").select(
        "gram", "h1", "h2", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.length("context") - length).cast("long").alias("last"))).alias("runs")
    )
    several = shards.filter("kinds > 1")
    sorted_ = _by_suffix_array(distinct.join(several.filter(F.col("bytes") <= shard_bytes).select("gram"), "gram"), length)
    counted = _by_count(distinct.join(several.filter(F.col("bytes") > shard_bytes).select("gram"), "gram"), length)
    runs = alone.unionByName(sorted_).unionByName(counted).filter(F.size("runs") > 0)
    found = contexts.drop("context", "at").join(runs, ["gram", "h1", "h2"])
    return found.select("place", F.col("first").alias("_first"), F.explode("runs").alias("run")).select(
        "place", (F.col("_first") + F.col("run.first")).alias("first"), (F.col("_first") + F.col("run.last")).alias("last")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``id``, ``place``, ``n_bytes``, ``kept`` (bytes) and ``spans`` (removed, by byte, end exclusive) of every document."""
    source = _source(docs, id_column, text)
    runs = repeated_runs(docs, length, id_column, text, shard_bytes)
    mine = runs.groupBy("place").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    rows = source.join(mine, "place", "left")
    kind = source.schema["id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> list:
        kept, spans = [], []
        for data, runs in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            if not runs:
                kept.append(data)
                spans.append([])
                continue
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, [r["first"] for r in runs], 1)
            np.add.at(change, [r["last"] + length for r in runs], -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [batch.column("id"), batch.column("place"), pc.binary_length(batch.column("data")).cast(pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)]

    schema = f"id {kind}, place {PLACE}, n_bytes bigint, kept binary, spans array<struct<start:bigint,end:bigint>>"
    return map_texts(rows, "data", schema, work)
