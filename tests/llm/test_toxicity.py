from __future__ import annotations

import random

import numpy as np
import pytest

from tests_llm_rows import ROWS
from winnow.llm import toxicity


def corpus(n=300, seed=2):
    r = random.Random(seed)
    words = ["haus", "baum", "river", "stone", "walk", "light", "été", "green"]
    docs, labels = [], []
    for k in range(n):
        bad, rude = k % 3 == 0, k % 6 == 0
        text = [r.choice(words) for _ in range(r.choice([4, 40]))] + ["grumble"] * bad + ["insultword"] * rude
        r.shuffle(text)
        docs.append((k, " ".join(text)))
        labels.append((k, int(bad), int(rude)))
    return docs, labels


def test_chain_finds_both_categories(llm):
    docs, labels = corpus()
    d, y = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, rough int, toxic int")
    rows = toxicity.classify(d, y, ["rough", "toxic"]).collect()
    truth = {k: (b, t) for k, b, t in labels}
    assert len(rows) == len(docs)
    assert np.mean([r.toxic == bool(truth[r.doc_id][1]) for r in rows]) > 0.98
    assert np.mean([(r.p_rough >= 0.5) == bool(truth[r.doc_id][0]) for r in rows]) > 0.98


def test_out_of_fold_probabilities_reach_the_next_model(llm):
    docs, labels = corpus(120)
    d, y = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, rough int, toxic int")
    chain = toxicity.learn_chain(toxicity.written(toxicity.sample(d, y, ["rough", "toxic"])), ["rough", "toxic"])
    assert [len(link.earlier) for link in chain] == [0, 1]
    assert chain[1].earlier[0] > 0  # toxic rows are rough rows here


def test_features_of_long_texts_are_those_of_their_parts(monkeypatch):
    text = " ".join(random.Random(1).choices(["abc", "defgh", "é"], k=3000)).encode()
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert (toxicity.features(text) == whole).all()
    assert (toxicity.features(b"  ABC\n defgh ") == toxicity.features(b"abc defgh")).all()


@pytest.mark.parametrize("labels", [[], [(1, 1, None)], [(1, 0, 0), (1, 0, 0), (None, 1, 1), (999, 1, 1)]])
def test_odd_documents_with_hardly_any_labels(odd_docs, no_docs, llm, labels):
    y = llm.createDataFrame(labels, "doc_id long, rough int, toxic int")
    rows = toxicity.classify(odd_docs, y, ["rough", "toxic"]).collect()
    assert len(rows) == len(ROWS) and not any(r.toxic for r in rows)
    assert all(0 <= r.p_rough <= 1 for r in rows)
    assert toxicity.classify(no_docs, y, ["rough", "toxic"]).collect() == []


def test_held_out_accuracy(llm):
    folder = "/root/testdata/sf0.1"
    docs, labels = (llm.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    learn, rest = labels.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 = 0")
    scored = toxicity.classify(docs, learn, ["toxic"]).withColumnRenamed("toxic", "guess")
    rows = scored.join(rest, "doc_id").select("guess", "toxic").collect()
    hit = sum(r.guess and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.5  # four in ten of these labels are noise: nothing toxic is there
    assert hit / max(1, sum(r.guess for r in rows)) > 0.85
