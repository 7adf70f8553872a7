"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, chat, decontaminate, exact, lines, pii, simhash, suffix, toxicity, urls
from strandline.scratch import stored

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i * i % 9973}" for i in range(40_000))
SAME = "first line here\nsecond line here\nthird line here\nfourth line " + "x" * 500
ROWS = [(1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, LONG), (6, SAME), (7, SAME), (7, SAME), (None, "a lone text of a few words"), (None, None)]
CLASHING = ["id", "place", "data", "locator", "digest", "keep", "fp", "gram", "_text", "_data", "_place", "score", "ids", "line", "pos", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return stored(frame.select("*", *(F.lit("other").alias(c) for c in CLASHING)), "edges")


@pytest.fixture(scope="module")
def nothing(spark):
    return stored(spark.createDataFrame([], "doc_id bigint, text string"), "nothing")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (6, 0), (7, None), (None, 1)], "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, LONG[500:800])], "item_id bigint, text string")


def test_bpe(docs, nothing):
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(out) == len(ROWS)
    assert {len(r.ids) for r in out if r.doc_id in (1, 2, 3)} == {0} and all(r.text == "" for r in out if r.doc_id in (1, 2, 3))
    assert next(r.text for r in out if r.doc_id == 4) == "word</w>" and all(r._text == "other" for r in out)
    assert len(next(r.ids for r in out if r.doc_id == 5)) > 40_000
    assert bpe.encode(nothing, PATH).count() == 0


def test_exact(docs, nothing):
    out = exact.exact_dedup(docs).collect()
    assert len(out) == len(ROWS) and sum(r.kept for r in out) == 6
    empties = [r for r in out if r.id in (1, 2) or (r.id is None and r.group_size == 3)]
    assert {r.keep_id for r in empties} == {2} and len(empties) == 3
    same = [r for r in out if r.id in (6, 7)]
    assert {(r.keep_id, r.group_size) for r in same} == {(7, 3)} and sum(r.kept for r in same) == 1
    assert exact.drop_copies(docs).count() == 6 and exact.drop_copies(docs).columns == docs.columns
    assert exact.exact_dedup(nothing).count() == 0


def test_simhash(docs, nothing):
    out = simhash.simhash_groups(docs).collect()
    assert len(out) == len(ROWS)
    assert {(r.fp, r.component_id) for r in out if r.id in (1, 2, 3)} == {(0, 1)}
    assert {r.component_id for r in out if r.id in (6, 7)} == {6}
    kept = simhash.drop_near_copies(docs)
    assert kept.count() == 5 and kept.columns == docs.columns
    assert simhash.simhash_groups(nothing).count() == 0


def test_decontaminate(docs, nothing, benchmark):
    assert {(r.id, r.item) for r in decontaminate.overlaps(docs, benchmark).collect()} == {(5, 4)}
    assert decontaminate.drop_contaminated(docs, benchmark).count() == len(ROWS) - 1
    assert decontaminate.overlaps(nothing, benchmark).count() == 0
    assert decontaminate.overlaps(docs, benchmark.limit(0)).count() == 0


def test_toxicity(docs, nothing, labels):
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    kept = toxicity.drop_toxic(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.filter("score = 'other'").count() == kept.count() > 0
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_pii(docs, nothing):
    out = pii.find_spans(docs, pii.fit(docs)).collect()
    assert len(out) == len(ROWS) and not any(r.base for r in out)
    assert pii.fit(nothing) is None and pii.find_spans(nothing, None).count() == 0


def test_lines(docs, nothing):
    out = {(r.id, r.n_lines, tuple(map(tuple, r.runs))) for r in lines.remove_repeated_lines(docs).collect()}
    assert (1, 1, ()) in out and (2, 1, ()) in out and (6, 4, ()) in out and (7, 4, ((0, 3),)) in out
    assert lines.remove_repeated_lines(nothing).count() == 0


def test_suffix(docs, nothing):
    out = suffix.remove_repeats(docs).collect()
    assert len(out) == len(ROWS)
    assert all(r.kept == b"" and len(r.spans) == 1 for r in out if r.id in (6, 7))
    assert all(len(r.kept) == r.n_bytes for r in out if r.id not in (5, 6, 7))
    assert suffix.remove_repeats(nothing).count() == 0


def test_urls(spark):
    rules = [urls.Rule("org", "/", "allow"), urls.Rule("com", "/bad/", "block")]
    rows = [
        (1, None, None), (2, "no scheme", ""), (3, "http://a.ORG/x?y", '<a href="http://b.net/1">'), (4, "http://c.com/bad/1#z", None),
        (5, "http://b.net/y", ""), (6, "http://d.net/q", '<A HREF=//c.com/bad/>'), (6, "http://d.net/q", "x" * 300_000), (None, "http://org", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("other")).withColumn("rank", F.lit(1))
    out = [(r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()]
    assert sorted(out, key=str) == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.org", "/x", "org/", "allow"), (4, "c.com", "/bad/1", "com/bad/", "block"),
            (5, "b.net", "/y", None, "allow"), (6, "d.net", "/q", None, "block"), (6, "d.net", "/q", None, "block"), (None, "org", "", None, "allow"),
        ],
        key=str,
    )
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad"), (2, 2, None, None),
        (3, 0, "user", None), (None, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "good"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit("other"))
    pairs = chat.pairs_by_opening(turns)
    assert {tuple(r) for r in pairs.collect()} == {(2, 1), (2, 4)}
    pairs = pairs.union(spark.createDataFrame([(1, 4), (1, 99)], "chosen_id bigint, rejected_id bigint"))
    out = {(r.chosen_id, r.rejected_id): r for r in chat.preference_pairs(turns, pairs).collect()}
    assert set(out) == {(2, 1), (2, 4), (1, 4)}
    one = out[2, 1]
    assert one.n_common == 1 and one.prompt == "<|user|>\nhi\n"
    assert one.chosen_completion == "<|assistant|>\nbad\n<||>\n\n" and one.rejected_completion == "<|assistant|>\ngood\n"
    assert [one.chosen_completion[s.start : s.end] for s in one.chosen_spans] == ["bad"]
    assert out[1, 4].chosen_completion == out[1, 4].rejected_completion == "" and out[1, 4].n_common == 2
    assert chat.preference_pairs(turns.limit(0), pairs).count() == 0
