"""Toxicity by weak supervision: many voters, a generative model of them, and a linear classifier on its posterior.

Voters look at a text's words and patterns: a general list of insults, one voter per word; the words most tied to
the label among the labelled training rows, one voter per word, beginning of words (4 to 8 bytes) or beginning that
two words of the text have; patterns; and one that votes for clean text where
no other found anything. The label model is fitted by expectation maximisation, anchored at the class balance and
the labels of the training rows: each voter's rate of voting under either class and, from the correlation of votes
within a class, how far voters repeat each other, by which their evidence is discounted. A logistic classifier over hashed words and votes is then
trained on the model's posterior, and scores every text whole.

Fitting uses at most SAMPLE labelled rows that are not held out (the lowest by hash of the identifier; one row of an
identifier that is repeated, the one with the greatest text), and of those no more than SAMPLE_BYTES of text: rows
that go over it in that order are left out whole. Of the features that may vote, the LEARNED_VOTERS most tied to the
label do, by how far their toxic rows exceed what chance gives. These bounds are documented parameters. Features are
counted in Spark; only the voters, and of each row its votes and buckets, come to the driver. Labels, language, source and identifiers are never inputs of a score.

Edge cases: null and empty texts get the classifier's base score; repeated rows get equal scores; texts of any length
are read whole; an empty table gives no rows; without labelled rows the fitted list alone votes and the base rate is
0.1; other columns pass through, whatever their names, except that ``score`` replaces a column of that name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.frames import fresh, map_texts
from strandline.scratch import stored
from strandline.llm.words import hash_of, mix, word_hashes

SAMPLE = 12_000
SAMPLE_BYTES = 128 << 20
LEARNED_VOTERS = 600
LEAST_ROWS, LEAST_SHARE, LEAST_DEVIATION = 6, 0.9, 4.0  # of learned voters: rows, toxic share, deviations over the base rate
STEMS = (8, 7, 6, 5, 4)  # bytes of a word's beginning, a feature of its own, and another where two words have it
BUCKETS = 1 << 16
BYTES_AT_ONCE = 1 << 18  # of texts: the hashes of their words and beginnings take some hundred bytes for each of theirs
# A general list of insulting words.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool loser losers scum trash garbage pathetic "
    "worthless useless disgusting filthy vermin clown jerk creep freak ugly hate hateful retard bastard bitch crap "
    "shit asshole fuck fucking damn"
).split()
# Patterns over the text in lower case.
PATTERNS = (
    rb"you(?:'re| are)? (?:such )?(?:an? )?(?:idiot|moron|loser|fool|clown|pathetic|worthless|stupid|disgusting)",
    rb"kill yourself",
    rb"go (?:to hell|die)",
    rb"shut (?:the \w+ )?up",
    rb"[0-9]d[i1][o0]t|m[o0]r[o0]n[0-9]|l[o0]s3r|stup[1!]d",
)


def features(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Hashes of all words and of the shortest beginnings of the longer ones, and the row of each; and, for voters only,
    those of the other beginnings and of beginnings that a text has twice, and the row of each."""
    words, rows, begin, end, *stems = word_hashes(column, *STEMS)
    found, at = [], []
    for length, stem in zip(STEMS, stems, strict=True):
        longer = end - begin > length
        own, row = stem[longer], rows[longer]
        order = np.lexsort((own, row))
        sorted_own, sorted_row = own[order], row[order]
        twice = (sorted_own[1:] == sorted_own[:-1]) & (sorted_row[1:] == sorted_row[:-1])
        found += [sorted_own[1:][twice] ^ np.uint64(64 + length), own ^ np.uint64(length)]
        at += [sorted_row[1:][twice], row]
    return np.r_[words, found.pop()], np.r_[rows, at.pop()], np.concatenate(found), np.concatenate(at)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(48)).astype(np.int64)


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string")) % 5 == 0


def _patterns(texts: list[bytes]) -> np.ndarray:
    found = [re.compile(p) for p in PATTERNS]
    return np.array([[p.search(t) is not None for p in found] for t in texts], bool).reshape(len(texts), len(found))


def _votes(words: np.ndarray, rows: np.ndarray, count: int, voters: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Rows by voters: 1 where the word or pattern is there; the last column, for clean text, where none is."""
    votes = np.zeros((count, len(voters) + patterns.shape[1] + 1), bool)
    place = np.minimum(np.searchsorted(voters, words), len(voters) - 1)
    hit = voters[place] == words
    votes[rows[hit], place[hit]] = True
    votes[:, len(voters) : -1] = patterns
    votes[:, -1] = ~votes[:, :-1].any(1)
    return votes


@dataclass
class LabelModel:
    """Class balance (given), each voter's rate of voting by class, and its share of evidence of its own."""

    balance: float
    rates: np.ndarray  # 2 by voters: clean, toxic
    own: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, toxic: np.ndarray, rounds: int = 20) -> LabelModel:
        """Expectation maximisation; half of the weight in each step comes from the labels, which tie the classes down."""
        voters = votes.shape[1]
        model = cls(float(np.clip(toxic.mean(), 0.01, 0.5)), np.full((2, voters), 0.5), np.ones(voters))
        guess = toxic.astype(float)
        for turn in range(rounds):
            weight = np.stack([1 - guess, guess])
            model.rates = np.clip((weight @ votes + 0.01) / (weight.sum(1)[:, None] + 0.1), 1e-5, 1 - 1e-5)
            if turn % 5 == 4:
                model.own = model.independence(votes, weight)
            guess = 0.5 * model.posterior(votes) + 0.5 * toxic
        return model

    def independence(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One over one plus the positive correlations with other voters within a class."""
        total = np.zeros((votes.shape[1],) * 2)
        for k in (0, 1):
            off = (votes - self.rates[k]) * np.sqrt(weight[k])[:, None]
            cover = off.T @ off
            spread = np.sqrt(np.maximum(np.diag(cover), 1e-9))
            total += weight[k].mean() * np.maximum(cover / spread[:, None] / spread, 0)
        np.fill_diagonal(total, 0)
        total[total < 0.1] = 0
        return 1 / (1 + total.sum(1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        # A voter that stays silent abstains: that is no evidence for either class.
        gain = votes @ (np.log(self.rates[1] / self.rates[0]) * self.own)
        return 1 / (1 + np.exp(-np.clip(gain + np.log(self.balance / (1 - self.balance)), -30, 30)))


@dataclass
class Model:
    voters: np.ndarray  # hashes of the voting words, ascending
    weights: np.ndarray  # of buckets, then of votes
    base: float


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int) -> DataFrame:
    """At most ``sample`` labelled rows and ``sample_bytes`` bytes of text: ``toxic`` and ``data``."""
    chosen = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # An identifier counts once, with its greatest text: the bound holds for rows.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    picked = stored(picked.select("doc_id", "toxic", F.coalesce("text", F.lit("")).cast("binary").alias("data")), "sample")
    # Of at most ``sample`` rows one task can add the lengths up.
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = picked.select("doc_id", F.sum(F.length("data")).over(so_far).alias("bytes")).filter(F.col("bytes") <= sample_bytes)
    return picked.join(F.broadcast(fitting.select("doc_id")), "doc_id", "left_semi").select("toxic", "data")


def _counted(rows: DataFrame) -> DataFrame:
    """Of every feature, in how many rows it is (``seen``) and in how many toxic ones (``bad``)."""

    def work(batch: pa.RecordBatch) -> list | None:
        words, row, more, more_row = features(batch.column("data"))
        names, at = np.r_[words, more], np.r_[row, more_row]
        order = np.lexsort((at, names))
        names, at = names[order], at[order]
        once = np.r_[True, (names[1:] != names[:-1]) | (at[1:] != at[:-1])][: len(names)]
        names, at = names[once], at[once]
        firsts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][: len(names)])
        if not len(firsts):
            return None
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        return [pa.array(names[firsts].view(np.int64)), pa.array(np.diff(np.r_[firsts, len(names)])), pa.array(np.add.reduceat(toxic[at], firsts))]

    found = map_texts(rows, "data", "feature bigint, seen bigint, bad bigint", work, BYTES_AT_ONCE)
    return found.groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))


def _voters(rows: DataFrame, share: float) -> np.ndarray:
    """The listed insults, unless the labels show one to be an ordinary word here, and the features most tied to the label.

    Features are counted in Spark; what comes back is the LEARNED_VOTERS best and the listed ones.
    """
    listed = np.unique(np.array([hash_of(w) for w in INSULTS], np.uint64))
    counted = stored(_counted(rows), "features")
    seen, bad = F.col("seen"), F.col("bad")
    known = counted.filter(F.col("feature").isin(listed.view(np.int64).tolist()) & (seen >= 8) & (bad < 0.3 * seen)).select("feature")
    ordinary = known.toArrow()["feature"].to_numpy().view(np.uint64)
    surplus = (bad - seen * share) / F.sqrt(seen * share * (1 - share))
    tied = counted.filter((seen >= LEAST_ROWS) & (bad >= LEAST_SHARE * seen)).withColumn("surplus", surplus).filter(F.col("surplus") >= LEAST_DEVIATION)
    best = tied.orderBy(F.desc("surplus"), F.col("feature").bitwiseXOR(F.lit(-(1 << 63)))).limit(LEARNED_VOTERS)
    learned = best.select("feature").toArrow()["feature"].to_numpy().view(np.uint64)
    return np.unique(np.r_[np.setdiff1d(listed, ordinary), learned])


def _training_rows(rows: DataFrame, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels; votes as a table; and the distinct buckets of all rows' words with the row of each."""
    shared = rows.sparkSession.sparkContext.broadcast(voters)

    def work(batch: pa.RecordBatch) -> list:
        words, row, more, more_row = features(batch.column("data"))
        votes = _votes(np.r_[words, more], np.r_[row, more_row], batch.num_rows, shared.value, _patterns([t.lower() for t in batch.column("data").to_pylist()]))
        pairs = np.unique(row.astype(np.int64) << 17 | bucket(words))
        ends = np.searchsorted(pairs >> 17, np.arange(batch.num_rows + 1)).astype(np.int32)
        buckets = pa.ListArray.from_arrays(ends, (pairs & (1 << 17) - 1).astype(np.int32))
        packed = pa.array([v.tobytes() for v in np.packbits(votes, axis=1)], pa.binary())
        return [batch.column("toxic").cast(pa.int32()), packed, buckets]

    found = map_texts(rows, "data", "toxic int, votes binary, buckets array<int>", work, BYTES_AT_ONCE).toArrow()
    if not len(found):
        return np.zeros(0, np.int32), np.zeros((0, len(voters) + len(PATTERNS) + 1), bool), np.zeros(0, np.int32), np.zeros(0, np.int32)
    packed = np.frombuffer(b"".join(found["votes"].to_pylist()), np.uint8).reshape(len(found), -1)
    votes = np.unpackbits(packed, axis=1, count=len(voters) + len(PATTERNS) + 1).astype(bool)
    sizes = pc.list_value_length(found["buckets"]).to_numpy()
    return found["toxic"].to_numpy(), votes, pc.list_flatten(found["buckets"]).to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _fit_linear(feature: np.ndarray, row: np.ndarray, target: np.ndarray, size: int, steps: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression with square penalty on presence features, by Adam over all rows."""
    weights, base = np.zeros(size), float(np.log(np.clip(target.mean(), 0.01, 0.9) / (1 - np.clip(target.mean(), 0.01, 0.9))))
    seen = np.bincount(feature, minlength=size)
    # Features as common in either class say nothing, and long texts would gather thousands of them.
    share = target.mean()
    surplus = np.bincount(feature, weights=target[row], minlength=size) - seen * share
    useless = (seen < 5) | (np.abs(surplus) < 3.5 * np.sqrt(seen * share * (1 - share)))
    used = ~useless[feature]
    feature, row = feature[used], row[used]
    mean, square, scale = np.zeros(size), np.zeros(size), 1 / max(1, len(target))
    for step in range(1, steps + 1):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weights[feature], minlength=len(target)) + base, -30, 30)))
        error = guess - target
        slope = np.bincount(feature, weights=error[row], minlength=size) * scale + 2e-4 * weights
        slope[useless] = 0
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights -= 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * 0.98**step
        base -= 0.5 * error.mean()
    return weights, base


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    rows = _sample(docs, labels, sample, sample_bytes)
    share = rows.agg(F.avg("toxic")).first()[0]
    voters = _voters(rows, float(np.clip(0.1 if share is None else share, 0.01, 0.99)))
    toxic, votes, buckets, row = _training_rows(rows, voters)
    size = BUCKETS + votes.shape[1]
    if not len(toxic):
        weights = np.zeros(size)
        weights[BUCKETS:-1] = 3.0
        return Model(voters, weights, float(np.log(0.1 / 0.9)))
    target = LabelModel.fit(votes, toxic).posterior(votes)
    voted_row, voted = np.nonzero(votes)
    feature = np.r_[buckets, (BUCKETS + voted).astype(np.int32)]
    weights, base = _fit_linear(feature, np.r_[row, voted_row.astype(np.int32)], target, size)
    return Model(voters, weights, base)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in the column ``name``."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    own = fresh("_data", docs)
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias(own))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> list:
        fitted, count = shared.value, batch.num_rows
        words, rows, more, more_rows = features(batch.column(own))
        votes = _votes(np.r_[words, more], np.r_[rows, more_rows], count, fitted.voters, _patterns([t.lower() for t in batch.column(own).to_pylist()]))
        pairs = np.unique(rows << 17 | bucket(words))
        total = np.bincount(pairs >> 17, weights=fitted.weights[pairs & (1 << 17) - 1], minlength=count) + votes @ fitted.weights[BUCKETS:] + fitted.base
        return [*(batch.column(i) for i in range(len(kept))), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))]

    fields = "".join(f"`{c}` {t}, " for c, t in source.drop(own).dtypes)
    return map_texts(source, own, f"{fields}`{name}` double", work, BYTES_AT_ONCE)


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that score 0.5 or more."""
    name = fresh("score", docs)
    return score(docs, fit(docs, labels, sample), name=name).filter(F.col(name) < 0.5).drop(name)
