from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_search import brute as brute_contamination
from test_simhash import plain_components, plain_fingerprint
from test_suffixes import brute as brute_removal
from winnow.llm.common import written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(llm):
    docs = [llm.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        docs.append(written(stage(llm, docs[-1], FOLDER)))
    return docs


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    for docs in stages[1:-1]:
        assert docs.dtypes == stages[0].dtypes
        assert docs.filter(F.col("n_chars") != F.length("text")).isEmpty()


def test_language_rejects_only_what_has_no_letter(stages):
    assert sorted(pairs(stages[1])) == sorted(p for p in pairs(stages[0]) if any(c.isalpha() for c in p[1]))


def test_one_of_each_group_stays(stages):
    docs = sorted(pairs(stages[1]))
    root = plain_components([plain_fingerprint(t) for _, t in docs])
    groups = defaultdict(list)
    for (i, _), r in zip(docs, root):
        groups[r].append(i)
    assert sorted(i for i, _ in pairs(stages[2])) == sorted(min(g) for g in groups.values())


def test_repeats_are_cut(stages):
    before = pairs(stages[2])
    expected = {r[0]: r[2] for r in brute_removal(before)}
    after = dict(pairs(stages[3]))
    for i, text in before:
        gone = len(text.encode()) - len(after[i].encode())
        assert expected[i] <= gone <= expected[i] + 6 * (expected[i] > 0)


def test_contaminated_go(stages, llm):
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = [r[0] for r in brute_contamination(pairs(stages[3]), items) if not r[5]]
    assert sorted(i for i, _ in pairs(stages[4])) == sorted(clean)


def test_everything_left_is_packed(stages):
    packed = stages[5]
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in pairs(stages[4])}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_odd_and_empty_documents(llm, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in pipeline.STAGES:
            docs = written(stage(llm, docs, FOLDER))
        assert docs.isEmpty() == (docs.count() == 0)
    ids = [r.doc_id for r in written(pipeline.drop_near_duplicates(llm, odd_docs, FOLDER)).collect()]
    assert ids.count(9) == 1
