"""Quality by compression: two zstandard dictionaries, trained on good and on bad labelled text, and how much better
the one shortens a text than the other.

A text is cut into blocks of BLOCK bytes that are compressed one by one, so that the dictionaries and not the text's
own past decide, however long the text is. The difference of the compressed sizes over their sum is taken for the
whole text and for the block that looks worst, as bad passages hide in good texts; a logistic curve over the two,
fitted on labelled rows that the dictionaries have not seen, makes a calibrated score of them.

Fitting uses at most SAMPLE labelled rows that are not held out (the lowest by hash of the identifier; of an
identifier that is repeated, the row with the greatest text), and of those no more than SAMPLE_BYTES of text: rows
that go over it in that order are left out whole. These bounds are documented parameters. Labels, language, source
and identifiers are never inputs of a score.

Edge cases: null and empty texts have a difference of zero and get the curve's value there; repeated rows get equal
scores; texts of any length are read whole; an empty table gives no rows; without labelled rows of both classes all
texts get the share of good ones among those there are, or 0.5; other columns pass through, whatever their names,
except that ``score`` replaces a column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.frames import fresh, map_texts

SAMPLE = 12_000
SAMPLE_BYTES = 64 << 20
BLOCK = 512
DICTIONARY_BYTES = 112_640
LEVEL = 3


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string")) % 3 == 1


def _second_half(id_column: Column) -> Column:
    """Rows for the curve; the others are for the dictionaries."""
    return F.floor(F.crc32(id_column.cast("string")) / 3) % 2 == 1


def blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself."""
    samples = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(known: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(known)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)


class Differences:
    """Normalised differences of compressed sizes, greater where the good dictionary fits better."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def of(self, data: bytes) -> tuple[float, float]:
        """Of the whole text, and of its worst block."""
        by_good = by_bad = 0
        worst = 1.0
        for block in blocks(data):
            good, bad = len(self.good.compress(block)), len(self.bad.compress(block))
            by_good, by_bad = by_good + good, by_bad + bad
            worst = min(worst, (bad - good) / (bad + good))
        return ((by_bad - by_good) / (by_bad + by_good), worst) if data else (0.0, 0.0)


@dataclass
class Model:
    good: bytes
    bad: bytes
    curve: np.ndarray  # of the two differences, and the base; with no dictionaries only the base counts


def fit_curve(inputs: np.ndarray, good: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's steps, with a small square penalty and targets kept off 0 and 1."""
    scale = np.maximum(inputs.std(0), 1e-6)
    rows = np.c_[inputs / scale, np.ones(len(inputs))]
    few = min(good.sum(), len(good) - good.sum()) + 2
    target = np.where(good, 1 - 1 / few, 1 / few)
    penalty = np.diag([0.1, 0.1, 1e-6])
    curve = np.zeros(3)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(rows @ curve, -30, 30)))
        slope = rows.T @ (target - chance) - penalty @ curve
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + penalty
        step = np.linalg.solve(bend, slope)
        curve += np.clip(step, -2, 2)
    return curve / np.r_[scale, 1]


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> pa.Table:
    """At most ``sample`` labelled rows and ``sample_bytes`` bytes: text, label and half."""
    chosen = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    picked = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("data").alias("data"))
    # At most ``sample`` rows are left, so one task can add their lengths up.
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = picked.select("doc_id", F.sum(F.length("data")).over(so_far).alias("bytes")).filter(F.col("bytes") <= sample_bytes)
    kept = picked.join(F.broadcast(fitting.select("doc_id")), "doc_id", "left_semi")
    return kept.orderBy("doc_id").select("data", (F.col("quality") == 1).alias("good"), _second_half(F.col("doc_id")).alias("late")).toArrow()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    found = _sample(docs, labels, sample, sample_bytes)
    texts, good, late = found["data"].to_pylist(), np.array(found["good"].to_pylist(), bool), np.array(found["late"].to_pylist(), bool)
    share = float(np.clip(good.mean(), 0.01, 0.99)) if len(good) else 0.5
    base = np.array([0, 0, np.log(share / (1 - share))])
    halves = [[t for t, g, l in zip(texts, good, late, strict=True) if g == side and not l and t] for side in (True, False)]
    if not all(halves):
        return Model(b"", b"", base)
    model = Model(*map(dictionary, halves), base)
    differences = Differences(model.good, model.bad)
    if good[late].any() and not good[late].all():
        inputs = np.array([differences.of(t) for t, l in zip(texts, late, strict=True) if l])
        model.curve = fit_curve(inputs, good[late])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in the column ``name``; greater is better."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    own = fresh("_data", docs)
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias(own))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready: list[Differences] = []

    def work(batch: pa.RecordBatch) -> list:
        fitted = shared.value
        inputs = np.zeros((batch.num_rows, 2))
        if fitted.curve[:2].any():
            if not ready:
                ready.append(Differences(fitted.good, fitted.bad))
            inputs = np.array([ready[0].of(t) for t in batch.column(own).to_pylist()]).reshape(-1, 2)
        total = inputs @ fitted.curve[:2] + fitted.curve[2]
        return [*(batch.column(i) for i in range(len(kept))), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))]

    fields = "".join(f"`{c}` {t}, " for c, t in source.drop(own).dtypes)
    return map_texts(source, own, f"{fields}`{name}` double", work)
