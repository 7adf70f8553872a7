"""Spelling variants: words one edit apart, grouped under the more frequent form.

Letters are hashed to a few symbols, and every distinct word so reduced generates its full neighbourhood of one edit:
itself, all deletions, all replacements by a symbol and all insertions of one. Reduced words are polynomials over
64 bits, so a neighbour's hash follows from the word's by arithmetic, for a whole block of words at once. Neighbours that are
reduced words of the vocabulary too are joined to it, and pairs are checked on the words themselves. Words one edit
apart have reduced words at most one edit apart, and every pair of reduced words is met once, so each near word is
found exactly once, from either side.

Before the shuffle a bit table of the reduced vocabulary, of bounded size, drops most neighbours that nothing
matches; past its size it only lets more of them into the join. Words that share a form are followed to the last form
by pointer jumping: a form is at least twice as frequent, so the rounds grow with the logarithm of a logarithm.

Edge cases: null and empty texts have no words; a null identifier counts as the empty text in the hash that decides on
deletions; repeated rows count again; of near words that tie, the smallest in code-point order is the form; texts and
words of any length are taken whole; an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.frames import map_arrow, pieces
from strandline.llm.words import FACTOR, flat_bytes, mix, powers
from strandline.scratch import stored

SYMBOLS = 8
LEAST_LETTERS, LEAST_COUNT = 5, 3
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
TABLE_BITS = 27  # 16 MB
PART_BITS = 15
WORDS_AT_ONCE = 200_000  # counted in a task before they are handed on
CELLS = 1 << 20  # neighbours made at once in a task
SHORT = 64
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def word_counts(
    docs: DataFrame, slip: int | None = None, least: int = LEAST_LETTERS, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``word``, ``n`` of all words of at least ``least`` letters, A-Z lowered.

    With ``slip``, a run of letters loses one letter in every document with which its hash divides by ``slip``; the
    letter follows from the hash as well.
    """
    # A run that loses a letter must have one more, so shorter runs are never words.
    pattern = f"[a-zÀ-ÿ]{{{least},}}"
    source = docs.select(
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(pattern).findall
        total: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in pieces(batch, "data"):
                for name, data in zip(piece.column("id").to_pylist(), piece.column("data").to_pylist(), strict=True):
                    # Of bytes, lower() changes A-Z only.
                    own = Counter(runs(data.lower().decode("utf-8", "replace")))
                    if slip is None:
                        total.update(own)
                        continue
                    begun = zlib.crc32(f"{name}:".encode())
                    for word, n in own.items():
                        value = zlib.crc32(word.encode(), begun)
                        if value % slip == 0:
                            at = value % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                if len(total) > WORDS_AT_ONCE:
                    yield told()
                    total.clear()
        yield told()

    return map_arrow(source, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The reduced words as rows of symbols from 1 on, those of one length together, and the rows they are of."""
    data, offsets = flat_bytes(column)
    sizes = np.diff(offsets)
    for length in np.unique(sizes):
        rows = np.flatnonzero(sizes == length)
        at_once = max(1, CELLS // (2 * SYMBOLS * (int(length) + 1)))
        for first in range(0, len(rows), at_once):
            some = rows[first : first + at_once]
            yield some, data[offsets[some][:, None] + np.arange(length)].astype(np.uint64) - np.uint64(ord("a") - 1)


def reduced_hash(symbols: np.ndarray) -> np.ndarray:
    return (symbols * powers(symbols.shape[1])[: symbols.shape[1]]).sum(1, dtype=np.uint64)


def neighbourhood(symbols: np.ndarray) -> np.ndarray:
    """Hashes of each row itself and of all rows one edit apart; some are there more than once."""
    count, length = symbols.shape
    power = powers(length + 1)[: length + 1]
    before = np.zeros((count, length + 1), np.uint64)
    np.cumsum(symbols * power[:length], axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    deleted = before[:, :-1] + (whole - before[:, 1:]) * INVERSE
    found = [whole, deleted]
    opened = before + (whole - before) * FACTOR
    for symbol in range(1, SYMBOLS + 1):
        found.append(whole + (np.uint64(symbol) - symbols) * power[:length])
        found.append(opened + np.uint64(symbol) * power)
    return np.concatenate(found, axis=1)


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _with_hash(words: DataFrame) -> DataFrame:
    """``word``, ``n``, the word ``reduced`` to symbols, its hash ``red`` and that hash's bit of the table."""
    symbols = "".join(chr(ord("a") + ord(c) % SYMBOLS) for c in LETTERS)
    bits = TABLE_BITS
    reduced = words.select("word", "n", F.translate("word", LETTERS, symbols).cast("binary").alias("reduced"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            red = np.zeros(batch.num_rows, np.uint64)
            for rows, part in _by_length(batch.column("reduced")):
                red[rows] = reduced_hash(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(red.view(np.int64)), pa.array(_bit(red, bits))], ["word", "n", "reduced", "red", "bit"])

    return map_arrow(reduced, run, "word string, n bigint, reduced binary, red bigint, bit bigint")


def _table(words: DataFrame) -> np.ndarray:
    """Bits of the reduced vocabulary, in at most 2**(TABLE_BITS - PART_BITS) pieces of 4 kB."""
    size = 1 << PART_BITS
    parts = words.groupBy(F.shiftright("bit", PART_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % size).alias("bits"))
    table = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    for row in parts.collect():
        table[row["part"] * size // 8 : (row["part"] + 1) * size // 8] = np.frombuffer(row["bits"], np.uint8)
    return table


def _met(words: DataFrame) -> DataFrame:
    """``source`` and ``key``: hashes of reduced words, the second in the neighbourhood of the first and very likely there."""
    shared, bits = words.sparkSession.sparkContext.broadcast(_table(words)), TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, symbols in _by_length(batch.column("reduced")):
                keys = neighbourhood(symbols)
                place = _bit(keys, bits)
                rows, at = np.nonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                source = reduced_hash(symbols)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(source.view(np.int64)), pa.array(keys[rows, at].view(np.int64))], ["source", "key"])

    return map_arrow(words.select("reduced").distinct(), run, "source bigint, key bigint").distinct()


def one_edit_apart(word: str, other: str) -> bool:
    longer, shorter = (word, other) if len(word) >= len(other) else (other, word)
    if len(longer) - len(shorter) > 1 or word == other:
        return False
    at = next((i for i, (a, b) in enumerate(zip(longer, shorter, strict=False)) if a != b), len(shorter))
    return longer[at + 1 :] == shorter[at + (len(longer) == len(shorter)) :]


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: all ordered pairs of ``words`` (word, n) that are one edit apart."""
    words = stored(_with_hash(words), "reduced")
    mine = words.select(F.col("red").alias("source"), "word", "n")
    others = words.select(F.col("red").alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = _met(words).join(mine, "source").join(others, "key").select("word", "n", "near", "near_n")
    # Spark's distance is quadratic in long words, which are left to the check that follows.
    pairs = pairs.filter((F.length("word") > SHORT) | (F.levenshtein("word", "near", 1) == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = map(one_edit_apart, batch.column("word").to_pylist(), batch.column("near").to_pylist())
            yield batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(pairs, run, "word string, n bigint, near string, near_n bigint")


def last_forms(links: DataFrame) -> DataFrame:
    """``word``, ``root``: where following ``form`` from each word of ``links`` (word, form) ends. Links have no circles."""
    now = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = now.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        jumped = stored(jumped, "roots")
        now = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with ``form``, ``form_n``, ``n_near`` and ``root``.

    The form is the near word of largest n, if that is at least twice the word's; the root is where forms end.
    """
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.join(near, "word", "left").withColumn("more", -F.col("best.n") >= 2 * F.col("n"))
    found = stored(
        found.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("more"), F.col("best.word")).alias("form"), F.when(F.col("more"), -F.col("best.n")).alias("form_n"),
        ),
        "forms",
    )
    roots = last_forms(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
