"""Phrases of words that keep company: counts by multikey quicksort of suffixes, and how far each beats its parts.

A suffix is a word with up to four that follow it in its piece. Suffixes are routed by their leading words with a range
partitioning, so that a task has all that lie between two borders, and a leading word however frequent is cut by the words
behind it. In a task, pointers to its suffixes are partitioned in three by one word at a time: what equals the pivot
goes on with the next word, and the weight of that part is the phrase's count. A part lighter than the least count is
abandoned unsorted. Only phrases that begin a task's first or last suffix can reach over a border; their counts
are always handed on, and counts of equal phrases are added up. So no phrase and no leading word is ever bound to
one task.

Before that, suffixes are cut where no phrase can be frequent: tables of counters over the hashes of words and pairs of
neighbours, then of threes whose pairs may be frequent, all of bounded size, tell those that are surely too
rare. Past their size they cut less; counts are exact whatever they let through. Equal suffixes of a block of texts are sent once,
with their number.

Edge cases: null and empty texts have no words; a null language counts as ``und``; repeated rows count again; ties are
broken as ``collocations`` says; texts and words of any length are taken whole; an empty table gives no rows; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.frames import map_arrow
from strandline.llm.tables import bits_for, frequent, holds
from strandline.llm.words import flat_bytes, mix, powers
from strandline.scratch import stored

LEAST = 100
LONGEST = 5
TABLED = 3  # words of the longest runs with a table; those of more cut hardly anything else
TABLE_BITS = None  # of the tables' counters; None lets the size of the texts decide
BYTES_AT_ONCE = 4 << 20  # of texts whose equal suffixes are sent once; a longer text comes alone
BUCKETS_AT_ONCE = 4 << 20
HASHED_AT_ONCE = 1 << 19
SUFFIXES_PER_TASK = 500_000
# What ends a piece, and what lies between words.
BREAKS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
END = b"\0"  # behind every word of a suffix but the last; sorts before all else
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each byte: itself with A-Z lowered, and 0 in words, 1 between them, 2 between pieces."""
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    kind = np.zeros(256, np.uint8)
    kind[list(BLANKS)], kind[list(BREAKS)] = 1, 2
    return lower, kind


def _polynomials(data: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, some words at a time: the sums take forty bytes for each of theirs."""
    found = np.zeros(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        stop = max(first + 1, int(np.searchsorted(ends, begin[first] + HASHED_AT_ONCE)))
        start, own = begin[first], begin[first:stop] - begin[first]
        sizes = ends[first:stop] - begin[first:stop]
        part = data[start : ends[stop - 1]]
        within = np.arange(len(part)) - np.repeat(own, sizes)
        spread = (part.astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[within]
        found[first:stop] = np.add.reduceat(spread, own)
        first = stop
    return found


class Tokens:
    """The words of a column of texts, in order."""

    def __init__(self, data: pa.Array, seeds: np.ndarray):
        """``seeds``: a number for each text's language, that its words' hashes begin with."""
        lower, kind = _letters()
        raw, offsets = flat_bytes(data)
        kinds = kind[raw]
        inside = kinds == 0
        before = np.r_[False, inside[:-1]] if len(raw) else inside
        firsts = offsets[:-1]
        before[firsts[firsts < len(raw)]] = False  # a word never goes over the end of a text
        starts = np.flatnonzero(inside & ~before)
        self.bytes = lower[raw[inside]]
        self.rows = np.searchsorted(offsets, starts, side="right") - 1
        self.begin = (np.cumsum(inside, dtype=np.int32)[starts] - 1).astype(np.int64)  # among the bytes of words
        ends = np.r_[self.begin[1:], len(self.bytes)]
        if not len(starts):
            self.follows, self.hashes = np.zeros(0, bool), np.zeros(0, np.uint64)
            return
        self.hashes = mix(_polynomials(self.bytes, self.begin, ends) ^ seeds[self.rows])
        # Whether a word's next one is in the same piece.
        piece = np.cumsum(kinds == 2, dtype=np.int32)[starts]
        self.follows = np.r_[(piece[1:] == piece[:-1]) & (self.rows[1:] == self.rows[:-1]), False]

    def runs(self, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one word, two, ... LONGEST: which places begin a run of so many that may be frequent, and the runs' hashes.

        The first table is of words and pairs, the others of one word more each. Beyond the last table it takes
        that both parts, without the last and without the first word, may be frequent.
        """
        found, hashes = np.ones(len(self.hashes), bool), self.hashes
        for k in range(1, LONGEST + 1):
            if k > 1:
                found = (self.follows if k == 2 else found) & found & shifted(found, 1)
                hashes = mix(hashes * PAIR + shifted(self.hashes, k - 1))
            at = max(0, k - 2)
            if at < len(tables):
                found = found.copy()
                found[found] = holds(tables[at], hashes[found])
            yield found, hashes

    def encoded(self) -> pa.DictionaryArray:
        offsets = np.r_[self.begin, len(self.bytes)].astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes)])
        return words.dictionary_encode()


def shifted(values: np.ndarray, places: int) -> np.ndarray:
    """What stands so many places on; nothing behind the end."""
    return np.r_[values[places:], np.zeros(min(places, len(values)), values.dtype)]


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut or put together to about ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for at, length in enumerate(pc.binary_length(batch.column("data")).to_pylist()):
            if size and size + length > most:
                held.append(batch.slice(start, at - start))
                yield pa.concat_batches(held)
                held, size, start = [], 0, at
            size += length
        held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def _seeds(langs: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For each text the number of its language, the languages, and the number that words' hashes begin with."""
    coded = langs.dictionary_encode()
    number, names = coded.indices.to_numpy(zero_copy_only=False), [n.encode() for n in coded.dictionary.to_pylist()]
    # The seed follows from the name, and is the same in all tasks.
    seed = np.array([int.from_bytes(n[-7:], "little") * 2654435761 + len(n) & (1 << 64) - 1 for n in names], np.uint64)
    return number, names, mix(seed)[number] if names else np.zeros(0, np.uint64)


def frequent_tables(source: DataFrame, least: int) -> list[np.ndarray]:
    """Tables of the words and pairs that are there ``least`` times, and of the threes of likely pairs."""
    tables: list[np.ndarray] = []
    # A word has some six bytes, and counts in each table.
    size = source.agg(F.sum(F.length("data"))).first()[0] or 0
    bits = TABLE_BITS or bits_for(size // 6)
    for k in range(2, TABLED + 1):
        shared = source.sparkSession.sparkContext.broadcast(list(tables))

        def hashes(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[np.ndarray]:
            for block in _blocks(batches, BYTES_AT_ONCE):
                tokens = Tokens(block.column("data"), _seeds(block.column("lang"))[2])
                for words, (found, own) in enumerate(tokens.runs(shared.value), 1):
                    if words == k or (words == 1 and k == 2):
                        yield own[found]
                    if words == k:
                        break

        tables.append(frequent(source, hashes, least, bits, BUCKETS_AT_ONCE))
    return tables


def escaped(word: bytes) -> bytes:
    """Without zero bytes, in the same order."""
    return word.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def unescaped(word: bytes) -> bytes:
    return re.sub(b"\1([\1\2])", lambda m: b"\0" if m[1] == b"\1" else b"\1", word) if b"\1" in word else word


def suffixes(source: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """``key`` (language and words), ``words`` (their number), ``weight``, and a ``salt`` for equal keys of other blocks.

    A language has a key without words too, that weighs as much as it has words.
    """
    shared = source.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, BYTES_AT_ONCE):
            number, names, seeds = _seeds(block.column("lang"))
            tokens = Tokens(block.column("data"), seeds)
            if not len(tokens.begin):
                continue
            lang = number[tokens.rows]
            # How many words each suffix has: as long as its beginnings may be frequent.
            length = np.zeros(len(tokens.begin), np.int64)
            for found, _ in tokens.runs(shared.value):
                length += found
            at = np.flatnonzero(length)
            length = length[at]
            coded = tokens.encoded()
            ids = np.r_[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(LONGEST, np.int64)]
            columns = [np.where(length > k, ids[at + k] + 1, 0) for k in range(LONGEST)]
            if len(coded.dictionary) < 1 << 21:  # three to a number
                columns = [columns[0] << 42 | columns[1] << 21 | columns[2], lang[at].astype(np.int64) << 42 | columns[3] << 21 | columns[4]]
            else:
                columns.append(lang[at].astype(np.int64))
            order = np.lexsort(columns)
            fresh = np.zeros(len(order), bool)
            fresh[:1] = True
            for column in columns:
                fresh[1:] |= column[order[1:]] != column[order[:-1]]
            firsts = np.flatnonzero(fresh)
            weight = np.diff(np.r_[firsts, len(order)])
            pick = order[firsts]
            words = pa.array([escaped(w) for w in coded.dictionary.to_pylist()], pa.binary())
            parts = [pa.array([escaped(n) for n in names], pa.binary()).take(pa.array(lang[at[pick]]))]
            for k in range(LONGEST):
                parts.append(words.take(pa.array(ids[at[pick] + k], mask=length[pick] <= k)))
            key = pc.binary_join_element_wise(*parts, END, null_handling="skip")
            salt = int(tokens.hashes[:64].sum(dtype=np.uint64) >> np.uint64(33))
            seen = np.bincount(lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([key, pa.array([escaped(n) for n in names], pa.binary())]),
                    pa.array(np.r_[length[pick], np.zeros(len(names), np.int64)].astype(np.int32)),
                    pa.array(np.r_[weight, seen]),
                    pa.array(np.full(len(pick) + len(names), salt, np.int32)),
                ],
                ["key", "words", "weight", "salt"],
            )

    return map_arrow(source, run, "key binary, words int, weight bigint, salt int")


def quicksort_counts(columns: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Of all prefixes at least ``least`` heavy: a row that has it, the number of its last column, its weight.

    Multikey quicksort of the rows' numbers: each part is split in three by its next column, and lighter parts are left.
    A negative value ends a row.
    """
    parts = [(np.arange(len(weights)), 0)]
    while parts:
        rows, depth = parts.pop()
        if depth == len(columns) or weights[rows].sum() < least:
            continue
        values = columns[depth][rows]
        pivot = np.partition(values[:: max(1, len(values) // 64)], -1 + (len(values[:: max(1, len(values) // 64)]) + 1) // 2)
        pivot = pivot[(len(pivot) - 1) // 2]
        same = rows[values == pivot]
        if len(same) < len(rows):
            parts += [(rows[values < pivot], depth), (rows[values > pivot], depth)]
        weight = int(weights[same].sum())
        if pivot >= 0 and weight >= least:
            yield int(same[0]), depth, weight
            parts.append((same, depth + 1))


def _counted(keys: pa.Array, weights: np.ndarray, least: int) -> dict[bytes, int]:
    """Counts of the phrases of one task's suffixes, language first; those that reach over its borders are partial."""
    split = pc.split_pattern(keys, END)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(split).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begin = np.cumsum(np.r_[0, sizes[:-1]])
    columns = [np.where(sizes > k, flat[np.minimum(begin + k, len(flat) - 1)], -1) for k in range(LONGEST + 1)]
    found = {}
    for row, depth, weight in quicksort_counts(columns, weights, least):
        if depth:
            found[END.join(keys[row].as_py().split(END)[: depth + 1])] = weight
    ends = pc.min_max(keys)
    for border in {ends["min"].as_py(), ends["max"].as_py()}:
        row = pc.index(keys, pa.scalar(border, keys.type)).as_py()
        same, parts = np.ones(len(weights), bool), border.split(END)
        for depth, column in enumerate(columns[: len(parts)]):
            same &= column == column[row]
            if depth:
                found[END.join(parts[: depth + 1])] = int(weights[same].sum())
    return found


def phrase_counts(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``k`` (its words) and ``a`` (its count) of all phrases of up to LONGEST words that are there
    ``least`` times or more; and ``lang``, ``n``, the words of each language."""
    source = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"),
    )
    found = stored(suffixes(source, frequent_tables(source, least)), "suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.concat_batches(held)
        counts = _counted(rows.column("key"), rows.column("weight").to_numpy(), least)
        parts = [[unescaped(p).decode() for p in key.split(END)] for key in counts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in parts], pa.string()), pa.array([" ".join(p[1:]) for p in parts], pa.string()),
                pa.array([len(p) - 1 for p in parts], pa.int32()), pa.array(list(counts.values()), pa.int64()),
            ],
            ["lang", "phrase", "k", "part"],
        )

    tasks = max(1, -(-found.count() // SUFFIXES_PER_TASK))
    routed = found.filter("words > 0").repartitionByRange(tasks, "key", "salt").select("key", "weight")
    counts = map_arrow(routed, run, "lang string, phrase string, k int, part bigint")
    phrases = counts.groupBy("lang", "phrase", "k").agg(F.sum("part").alias("a")).filter(F.col("a") >= least)
    totals = found.filter("words = 0").groupBy("key").agg(F.sum("weight").alias("n")).filter("n > 0")
    # Escapes are rare, and a language is a column of the result in its own form.
    plain = F.replace(F.replace(F.col("key").cast("string"), F.lit("\1\1"), F.lit("\0")), F.lit("\1\2"), F.lit("\1"))
    return stored(phrases, "phrases"), stored(totals.select(plain.alias("lang"), "n"), "totals")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words or more with ``l``, ``r``, ``n`` and ``score`` of their lowest-scoring cut, the first of them."""
    known = phrases.select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    cuts = phrases.filter("k > 1").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "*", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice(words, F.col("cut") + 1, F.col("k")), " ").alias("right")
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    # Products of up to 37 digits, exact.
    wide = lambda c: f"CAST({c} AS DECIMAL(18,0))"
    score = F.expr(f"({wide('a')} * {wide('1000 * n')}) DIV ({wide('l')} * {wide('r')})")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    return cuts.groupBy("lang", "phrase", "k", "a", "n").agg(lowest).select("lang", "phrase", "k", "a", "n", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's first ``top`` phrases by score, then count, then phrase: lang, rank, phrase, a, l, r, n, score.

    Phrases within a longer one that is as frequent are left out.
    """
    phrases, totals = phrase_counts(docs, least, lang, text)
    # A phrase within a longer one of the same count is within one that is a single word longer, of that count too.
    words = F.split("phrase", " ")
    longer = phrases.filter("k > 2").select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k")), " "))).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored(phrases, totals).join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR longer < a").drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First among some of a language, so that no task sorts all of one.
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
