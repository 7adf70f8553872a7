"""Registered queries next to their SQL, and the pipeline stage by stage."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from compare import oracle, spark_rows, sql_rows

from strandline.llm.queries import ORACLES, QUERIES
from strandline.scratch import stored

SF = "/root/testdata/sf0.01"


def similar_kept(texts):
    """Of plain components of texts with a Jaccard similarity of 0.8 or more of their five-word runs, the least identifiers."""
    sets, having = {}, defaultdict(list)
    for i, text in texts.items():
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        runs = {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets[i] = frozenset(runs)
        for run in runs:
            having[run].append(i)
    met = defaultdict(int)
    for there in having.values():
        met.update(((a, b), met[a, b] + 1) for n, a in enumerate(there) for b in there[n + 1 :])
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), both in met.items():
        if both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    empty = sorted(i for i in texts if not sets[i])
    return {i for i in texts if find(i) == i} - set(empty[1:])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_as_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(oracle(SF), ORACLES[name])


def test_stages_keep_documents_and_do_what_the_queries_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and len(after) > 0.8 * len(before)
        kept.append(after)
    _, exact, near, _ = kept
    assert len(set(exact.values())) == len(exact)
    assert set(kept[0].values()) == set(exact.values())
    assert set(near) == similar_kept(exact)
    last = stored(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "bpe")
    assert last.count() == docs.count() and all(len(r.ids) == len(r.text.split()) for r in last.collect())
