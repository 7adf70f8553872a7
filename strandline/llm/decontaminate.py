"""Documents that hold text of a benchmark, found by spaced seeds, with substitutions allowed.

A seed is a hash of some words of a window and ignores the others, by three fixed masks. Together they catch every
13 aligned words of which at least 11 agree, wherever the differing words are. Seeds of the benchmark and of the
documents are joined; a bit table of the benchmark's seeds, of bounded size, lets only promising windows of the
documents into that join. Around each hit the words are compared one by one, and stretches with at least 80 % of
13 words equal (of all words, for items of 5 to 12 words) are reported.

Words are runs of letters, digits and characters beyond ASCII, in lower case; punctuation plays no part.

Edge cases: null and empty texts, and items of fewer than 5 words, match nothing; of items with the same words the
least item_id is reported; a document of fewer than 13 words matches only items that are as short: within a longer item, so few words are
no evidence; repeated documents are each reported; an empty table of either kind gives no rows;
other columns play no part, whatever their names. Texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandline.llm.frames import map_arrow, map_texts
from strandline.llm.places import PLACE, placed, without
from strandline.llm.words import mix, word_hashes
from strandline.scratch import stored

WINDOW = 13
SHARE = 0.8
# The words each mask looks at. All pairs of differing words among 13 leave one mask whole somewhere.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 2, 3, 7, 8, 10), (0, 1, 3, 4, 5, 6))
SHORTEST = 5  # words of the shortest item searched for
TABLE_BITS = 24  # at most 2 MB; past it the table only lets more windows into the join


def seeds(words: np.ndarray, rows: np.ndarray, offsets: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and the windows' first words, for windows within one text."""
    count = len(words) - offsets[-1]
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(count, salt, np.uint64)
    for o in offsets:
        total = total * np.uint64(0x2545F4914F6CDD1D) + words[o : o + count]
    whole = np.flatnonzero(rows[:count] == rows[offsets[-1] :])
    return mix(total[whole]), whole


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = np.uint64(64 - TABLE_BITS)
    return (hashes >> bits).astype(np.int64), (hashes * np.uint64(0x9E3779B97F4A7C15) >> bits).astype(np.int64)


def benchmark_words(benchmark: DataFrame) -> DataFrame:
    """``item``, ``item_words`` (hashes) of the items with distinct words and at least SHORTEST of them."""
    source = benchmark.select(F.col("item_id").alias("item"), F.coalesce(F.lower("text"), F.lit("")).cast("binary").alias("data"))

    def work(batch: pa.RecordBatch) -> list:
        words, rows, _, _ = word_hashes(batch.column("data"))
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return [batch.column("item"), pa.ListArray.from_arrays(ends, words.view(np.int64))]

    kind = source.schema["item"].dataType.simpleString()
    found = map_texts(source, "data", f"item {kind}, item_words array<bigint>", work)
    return found.filter(F.size("item_words") >= SHORTEST).groupBy("item_words").agg(F.min("item").alias("item"))


def _item_masks(length: int) -> tuple[tuple[int, ...], ...]:
    """Short items are matched by every word but at most one or two: each run of a third of them is a mask."""
    if length >= WINDOW:
        return MASKS
    part = max(1, length // (length - _needed(length) + 1))
    return (tuple(range(part)),)


def _needed(length: int) -> int:
    return -(-min(length, WINDOW) * 4 // 5)  # 80 %, rounded up


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """``seed``, ``item``, ``item_at`` of every window of every item, and ``item_words``."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words in enumerate(batch.column("item_words").to_pylist()):
                known = np.array(words, np.int64).view(np.uint64)
                one = np.zeros(len(known), np.int64)
                for mask in _item_masks(len(known)):
                    hashes, at = seeds(known, one, mask, len(mask) * 1000 + mask[-1])
                    n = len(hashes)
                    columns = [hashes.view(np.int64), at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0]), batch.column("item").take(pa.array([i] * n, pa.int32())), pa.array(columns[1]), pa.array([len(known)] * n, pa.int64())],
                        ["seed", "item", "item_at", "item_size"],
                    )

    return map_arrow(items.select("item", "item_words"), run, f"seed bigint, item {kind}, item_at bigint, item_size bigint")


def _table(found: DataFrame) -> np.ndarray:
    """Bits of all seeds; Spark ORs them into at most 2**TABLE_BITS / 32,768 pieces."""
    bits = F.col("bit").cast(LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate(_probes(batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(both))], ["bit"])

    parts = (
        map_arrow(found.select("seed"), run, "bit bigint")
        .groupBy(F.shiftright(bits, 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
        .collect()
    )
    table = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for row in parts:
        start = row["part"] * 4096
        table[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def promising(docs: DataFrame, table: np.ndarray, masks: list[tuple[int, ...]], id_column: str, text: str) -> DataFrame:
    """Windows around the words whose seeds are in the table: ``id``, ``place``, ``start``, ``words``, ``hits`` (seed, at)."""
    source = placed(docs).select(F.col(f"`{id_column}`").alias("id"), F.col("_place").alias("place"), F.coalesce(F.lower(F.col(f"`{text}`")), F.lit("")).cast("binary").alias("data"))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batch: pa.RecordBatch) -> list | None:
        words, rows, _, _ = word_hashes(batch.column("data"))
        bits = shared.value
        found, places = [], []
        for mask in masks:
            hashes, at = seeds(words, rows, mask, len(mask) * 1000 + mask[-1])
            for probe in (0, 1):
                place = _probes(hashes)[probe]
                good = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                hashes, at = hashes[good], at[good]
            found.append(hashes)
            places.append(at)
        seed, at = np.concatenate(found), np.concatenate(places)
        if not len(seed):
            return None
        order = np.argsort(at, kind="stable")
        seed, at = seed[order], at[order]
        ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        row = rows[at]
        low = np.maximum(at - WINDOW, ends[row])
        high = np.minimum(at + 2 * WINDOW, ends[row + 1])
        # Windows that touch within a text become one.
        fresh = np.r_[True, (row[1:] != row[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])]
        group = np.flatnonzero(fresh)
        start, stop = low[group], np.maximum.reduceat(high, group)
        owner = row[group]
        sizes = np.cumsum(np.r_[0, stop - start]).astype(np.int32)
        flat = np.concatenate([words[a:b] for a, b in zip(start, stop, strict=True)])
        hits = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array(at - np.repeat(start, np.diff(np.r_[group, len(at)])))], ["seed", "at"])
        pick = pa.array(owner)
        return [
            batch.column("id").take(pick),
            batch.column("place").take(pick),
            pa.array(start - ends[owner]),
            pa.ListArray.from_arrays(sizes, flat.view(np.int64)),
            pa.ListArray.from_arrays(np.r_[group, len(at)].astype(np.int32), hits),
        ]

    schema = f"id {kind}, place {PLACE}, start bigint, words array<bigint>, hits array<struct<seed:bigint,at:bigint>>"
    return map_texts(source, "data", schema, work)


def stretch(equal: np.ndarray, size: int) -> tuple[int, int, int] | None:
    """First and end place, and equal words, of the windows of ``size`` with enough equal words; None without any."""
    need = _needed(size)
    size = min(size, WINDOW)
    if len(equal) < size:
        return None
    sums = np.cumsum(np.r_[0, equal])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= need)
    if not len(good):
        return None
    inside = np.flatnonzero(equal[good[0] : good[-1] + size]) + good[0]
    return int(inside[0]), int(inside[-1]) + 1, int(len(inside))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``place``, ``item``, ``first_word``, ``end_word``, ``equal_words``: every stretch shared with an item."""
    items = stored(benchmark_words(benchmark), "items")
    found = stored(benchmark_seeds(items), "seeds")
    sizes = [r["n"] for r in items.select(F.least(F.size("item_words"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # at most 9 rows
    masks = list(dict.fromkeys(m for n in sizes for m in _item_masks(n)))
    windows = stored(promising(docs, _table(found), masks or [MASKS[0]], id_column, text), "windows")
    hits = windows.select("*", F.explode("hits").alias("hit")).select("id", "place", "start", "words", "hit.seed", "hit.at")
    pairs = (
        hits.join(found, "seed")
        .withColumn("shift", F.col("at") - F.col("item_at"))
        .dropDuplicates(["place", "start", "item", "shift"])
        .join(items, "item")
        .select("id", "place", "start", "words", "item", "item_words", "shift")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            columns = [batch.column(c).to_pylist() for c in ("start", "words", "item_words", "shift")]
            for i, (start, words, item, shift) in enumerate(zip(*columns, strict=True)):
                low, high = max(0, shift), min(len(words), shift + len(item))
                equal = np.array(words[low:high]) == np.array(item[low - shift : high - shift])
                if (span := stretch(equal, len(item))) is not None:
                    kept.append(i)
                    spans.append((start + low + span[0], start + low + span[1], span[2]))
            pick = pa.array(kept, pa.int32())
            ends = [pa.array([s[k] for s in spans], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pick) for c in ("id", "place", "item")), *ends],
                ["id", "place", "item", "first_word", "end_word", "equal_words"],
            )

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"id {kind['id']}, place {PLACE}, item {kind['item']}, first_word bigint, end_word bigint, equal_words bigint"
    return map_arrow(pairs, run, schema).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, read from files, without those that share a stretch with the benchmark."""
    return without(docs, overlaps(docs, benchmark, id_column, text).select("place").distinct())
