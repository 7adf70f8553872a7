"""Spelling variants, quality by compression and phrases, against plain versions and on held-out rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import phrases, quality, queries, spelling
from strandline.scratch import stored

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{chr(97 + i % 26)}{'x' * (i % 7)} " for i in range(60_000))
CLASHING = ["id", "data", "word", "n", "red", "score", "_data", "key", "words", "weight", "phrase"]


def one_edit(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    made = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (made | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def plain_variants(rows, slip=97, least=3):
    words = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            value = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if value % slip == 0:
                run = run[: value % len(run)] + run[value % len(run) + 1 :]
            words[run] += len(run) >= 5
    words = {w: n for w, n in words.items() if n >= least}
    letters = sorted({c for w in words for c in w})
    found = {}
    for word, n in words.items():
        near = [v for v in one_edit(word, letters) if v in words]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        found[word] = best if best is not None and words[best] >= 2 * n else None, n, len(near)

    def root(word):
        return word if found[word][0] is None else root(found[word][0])

    return {(w, form, root(w), n, near, words.get(form)) for w, (form, n, near) in found.items()}


def test_spelling_query_as_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = {tuple(r) for r in queries.op11_spelling(spark, SF).collect()}
    assert len(found) > 10_000 and any(f[1] for f in found) and found == plain_variants(rows)


@pytest.mark.parametrize("bits", [spelling.TABLE_BITS, spelling.PART_BITS])
def test_spelling_chains_ties_and_edges(spark, monkeypatch, bits):
    monkeypatch.setattr(spelling, "TABLE_BITS", bits)  # a full table lets everything through
    monkeypatch.setattr(spelling, "WORDS_AT_ONCE", 3)
    make = random.Random(2)
    chain = ["planes", "planer", "planet", "plane", "plansé"]
    rows = [(i, " ".join(w for w, n in zip(chain, (3, 6, 12, 30, 3)) for _ in range(n))) for i in range(2)]
    rows += [(None, None), (4, ""), (5, "abcdefgh " * 3 + "z" * 200), (5, "z" * 200), (6, "y" + "z" * 200 + " " + "z" * 200)]
    rows += [(7, " ".join("".join(make.choice("ab") for _ in range(make.randint(5, 8))) for _ in range(3000)))]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit("other").alias(c) for c in CLASHING)), "edges")
    words = spelling.word_counts(docs, 97).filter("n >= 3")
    found = {tuple(r) for r in spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert found == plain_variants(rows)
    assert ("planes", "planet", "plane") in {f[:3] for f in found} or any(f[1] != f[2] and f[1] for f in found)
    assert spelling.spelling_variants(spelling.word_counts(docs.limit(0))).count() == 0


def test_very_long_words(spark):
    words = spark.createDataFrame([("z" * 50_000, 9), ("z" * 50_001, 3), ("y" + "z" * 50_000, 4), ("q" * 50_000, 5)], "word string, n bigint")
    found = {(len(r.word), r.n): (r.n_near, r.form_n) for r in spelling.spelling_variants(words).collect()}
    assert found == {(50_000, 9): (2, None), (50_001, 3): (2, 9), (50_001, 4): (2, 9), (50_000, 5): (0, None)}


def test_neighbourhood_is_all_of_one_edit():
    words = ["abcdefgh", "hgfedcba", "aaaaaaaa"]
    symbols = np.array([[ord(c) - 96 for c in w] for w in words], np.uint64)
    found = spelling.neighbourhood(symbols)
    for word, hashes in zip(words, found, strict=True):
        wanted = one_edit(word, "abcdefgh") | {word}
        named = {int(spelling.reduced_hash(np.array([[ord(c) - 96 for c in w]], np.uint64))[0]) for w in wanted}
        assert named == set(map(int, hashes))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = queries.op12_quality(spark, sf).filter("held_out").join(labels, "doc_id").filter("quality IS NOT NULL").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1]
    assert len(bad) > 100 and sum(r.predicted == 0 for r in bad) > 0.85 * len(bad)
    assert sum(r.predicted == 1 for r in good) > 0.97 * len(good)
    # Expected calibration error: how far scores are from the share of good rows among those scored alike.
    tenths = [[r for r in rows if int(r.score * 10) == k] for k in range(11)]
    assert sum(abs(sum(r.score - r.quality for r in some)) for some in tenths) < 0.03 * len(rows)


def test_quality_edges(spark):
    good, bad = "a fine and quiet sentence about rivers and hills. ", "BUY!! NOW!! $$$ ||| "
    rows = [(i, (good if i % 3 else bad) * (i % 40 + 1)) for i in range(600)]
    rows += [(None, None), (1000, ""), (1001, good * 40_000), (1001, good * 40_000), (1002, None), (1003, "\x00￿")]
    docs = stored(spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit("other").alias(c) for c in CLASHING)), "edges")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (1002, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r._data == "other" for r in out)
    assert len({r.score for r in out if r.doc_id in (1000, 1002) or r.doc_id is None}) == 1 == len({r.score for r in out if r.doc_id == 1001})
    assert all((r.score > 0.5) == (r.doc_id % 3 > 0) for r in out if r.doc_id is not None and r.doc_id < 600)
    assert len(quality._sample(docs, labels, 50, 1 << 20)) == 50
    small = quality._sample(docs, labels, 50, 5000)
    assert 0 < len(small) < 50 and sum(len(t.as_py()) for t in small["data"]) <= 5000
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def plain_counts(rows, least):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            counts.update((lang or "und", " ".join(words[i : i + k])) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    return {key: n for key, n in counts.items() if n >= least}, {k: n for k, n in totals.items() if n}


def plain_collocations(rows, least, top):
    counts, totals = plain_counts(rows, least)
    kept = []
    for (lang, phrase), a in counts.items():
        words = phrase.split(" ")
        if len(words) < 2:
            continue
        inside = any(o == lang and n >= a and len(p) > len(phrase) and f" {phrase} " in f" {p} " for (o, p), n in counts.items())
        if not inside:
            cuts = [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]
            found = [(1000 * a * totals[lang] // (counts[lang, x] * counts[lang, y]), k, counts[lang, x], counts[lang, y]) for k, (x, y) in enumerate(cuts)]
            score, _, left, right = min(found)
            kept.append((lang, phrase, a, left, right, totals[lang], score))
    out = set()
    for lang in totals:
        ranked = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out |= {(lang, rank, *x[1:]) for rank, x in enumerate(ranked[:top], 1)}
    return out


ODD = ["a", "b", "c\x01", "c", "\x00", "\x01\x02", "É", "z中", "long" * 50, "The", "the", "x y"]


@pytest.mark.parametrize("bits, task", [(None, 1_000_000), (16, 400)])
def test_phrases_as_plain_python(spark, monkeypatch, bits, task):
    monkeypatch.setattr(phrases, "TABLE_BITS", bits)
    monkeypatch.setattr(phrases, "SUFFIXES_PER_TASK", task)
    monkeypatch.setattr(phrases, "BYTES_AT_ONCE", 3000)
    monkeypatch.setattr(phrases, "BUCKETS_AT_ONCE", 2000)
    make = random.Random(4)
    weights = [1 / (i + 1) for i in range(len(ODD))]
    rows = []
    for i in range(120):
        words = make.choices(ODD, weights, k=make.randint(0, 200))
        rows.append((make.choice(["en", "en", "en", None, "und", "d\x01"]), "".join(w + make.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \r\n"]) for w in words)))
    rows += [("en", None), (None, ""), ("xx", " \t . "), ("en", "hot pair here again now " * 5000), ("fr", "solo " * 30_000)]
    docs = stored(spark.createDataFrame(rows, "lang string, text string").select("*", *(F.lit("other").alias(c) for c in CLASHING)).repartition(5), "edges")
    counts, totals = phrases.phrase_counts(docs, 7)
    assert {(r.lang, r.phrase): r.a for r in counts.collect()} == plain_counts(rows, 7)[0]
    assert {r.lang: r.n for r in totals.collect()} == plain_counts(rows, 7)[1]
    assert {tuple(r) for r in phrases.collocations(docs, 7, 40).collect()} == plain_collocations(rows, 7, 40)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    counted = [("x", "a", 1, 10**13), ("x", "b", 1, 10**13 + 7), ("x", "a b", 2, 10**13 - 9)]
    found = phrases.scored(spark.createDataFrame(counted, "lang string, phrase string, k int, a bigint"), spark.createDataFrame([("x", 10**14)], "lang string, n bigint"))
    assert found.first().score == 1000 * (10**13 - 9) * 10**14 // (10**13 * (10**13 + 7))


def test_quicksort_counts_all_heavy_prefixes():
    make = random.Random(6)
    rows = [tuple(make.choices(range(4), k=make.randint(1, 4))) for _ in range(2000)]
    weights = np.array([make.randint(1, 3) for _ in rows])
    columns = [np.array([r[k] if k < len(r) else -1 for r in rows]) for k in range(4)]
    found = {rows[row][: depth + 1]: weight for row, depth, weight in phrases.quicksort_counts(columns, weights, 50)}
    wanted = Counter()
    for row, weight in zip(rows, weights.tolist(), strict=True):
        wanted.update({row[:k]: weight for k in range(1, len(row) + 1)})
    assert found == {p: n for p, n in wanted.items() if n >= 50}


def test_escapes_keep_the_order():
    words = [bytes(random.Random(i).choices([0, 1, 2, 97], k=i % 6)) for i in range(300)]
    assert all(b"\0" not in phrases.escaped(w) and phrases.unescaped(phrases.escaped(w)) == w for w in words)
    assert sorted(words, key=lambda w: phrases.escaped(w)) == sorted(words)
    assert pa.array([phrases.escaped(w) for w in words], pa.binary()).null_count == 0
