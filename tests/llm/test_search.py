from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_rows import ROWS
from winnow.llm import decontamination as dec
from winnow.llm import language, topk
from winnow.llm.common import written


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    phrases = {}
    for item, text in items:
        w = words(text)
        for at in range(max(len(w) - 12, 1)) if w else ():
            phrases.setdefault(tuple(w[at:at + 13]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, met = words(text), set(), set()
        for phrase, ids in phrases.items():
            for at in range(len(w) - len(phrase) + 1):
                if tuple(w[at:at + len(phrase)]) == phrase:
                    hit.update(range(at, at + len(phrase)))
                    met |= ids
        out.append((doc, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_odd_documents_and_items(llm, odd_docs, no_docs):
    items = [(1, "The cat sat on the mat, and the dog didn't mind."), (10, "cat SAT"), (2, ""), (3, None), (None, "other"),
             (5, "a"), (5, "a"), (7, "absentword cat"), (8, "the cat sat on the mat and the dog didn t mind and more words here")]
    table = llm.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, window int, key int")
    assert result(dec.contamination(odd_docs, table)) == brute(ROWS, items)
    assert result(dec.contamination(odd_docs, table.limit(0))) == brute(ROWS, [])
    assert dec.contamination(no_docs, table).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(llm, seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "a", "été", "x1", "rare", "Äh"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, make(r.choice([1, 2, 5, 13, 14, 30]))) for k in range(8)]
    docs = [(k, make(r.choice([0, 3, 40])) + " " + (r.choice(items)[1] if k % 2 else "") + " " + make(6)) for k in range(40)]
    docs += [(100 + k, docs[1][1]) for k in range(20)]
    spark_docs = llm.createDataFrame(docs, "doc_id long, text string")
    assert result(dec.contamination(spark_docs, llm.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_proximity(llm):
    texts = llm.createDataFrame([("k", "a b c a x x x x b"), ("m", "b x x a")], "key string, text string")
    lists = written(dec.postings(texts, llm.createDataFrame([("a",), ("b",)], "term string")))
    pairs = llm.createDataFrame([("a", "b"), ("a", "a")], "left_term string, right_term string")
    rows = dec.proximity_matches(lists, pairs, 3).collect()
    assert sorted((r.left_term, r.right_term, r.key, r.left_pos, r.right_pos) for r in rows) == [
        ("a", "a", "k", 0, 3), ("a", "b", "k", 0, 1), ("a", "b", "k", 3, 1), ("a", "b", "m", 3, 0)]


def best(rows, every, k):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for own, (q, a) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for at, (i, b) in enumerate(good) if at != own)[:k]
            out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))
    return out


def test_top_k_of_odd_vectors(llm):
    r = random.Random(5)
    rows = [(i, [r.choice([-1.5, 0.0, 0.01, 0.9, 2.0]) for _ in range(8)]) for i in range(400)]
    rows += [(i, [1.0] * 8) for i in range(400, 600)]
    rows += [(600, None), (601, [1.0, None]), (620, [float("nan")] * 8), (None, [1.0] * 8), (640, [float("inf")] * 8), (660, []), (20, [0.9] * 8),
             (20, [0.9] * 8), (40, []), (41, [2.0] * 3), (60, [-1.0] * 8)]
    table = llm.createDataFrame([(*x, 0, "x") for x in rows], "vec_id long, embedding array<float>, range int, data string")
    got = Counter((x.query_id, x.rank, x.vec_id, x.score) for x in topk.search(table).collect())
    assert got == best(rows, 20, 20)
    vectors = written(topk.whole_vectors(table))
    cells = topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, range_rows=70, chunk_rows=7, block=16).collect()
    assert Counter((x.query_id, x.rank, x.vec_id, x.score) for x in cells) == got
    assert topk.search(table.limit(0)).collect() == []
    pair = llm.createDataFrame([(20, [1.0, 2.0]), (20, [0.5, 0.5]), (1, [1.0, 1.0]), (3, [])], "vec_id long, embedding array<float>")
    assert topk.search(pair).count() == 6
    few = topk.search(table.filter("vec_id < 3")).collect()
    assert [(x.query_id, x.rank) for x in few] == [(0, 1), (0, 2)]


def test_blocks_are_pruned_and_large_values_exact():
    r = np.random.default_rng(1)
    vectors = np.sort(r.integers(-50, 50, (2000, 4)), axis=0)
    who, top, scored = topk.best_of_blocks(np.array([-1]), np.array([[9, 9, 9, 9]]), np.arange(2000), np.arange(2000), vectors, 5, 100)
    assert scored < 20 and top[0].tolist() == sorted((vectors * 9).sum(axis=1).tolist())[-5:][::-1]
    big = np.array([[2**30, 3], [2**30, 4]])
    assert topk._product(big, big).tolist() == [[2**60 + 9, 2**60 + 12], [2**60 + 12, 2**60 + 16]]


def test_language_of_odd_documents(llm, odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == len(ROWS)
    letters = {(i, t) for i, t in ROWS if t and any(c.isalpha() for c in t)}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.lang_pred)
    for i, t in ROWS:
        assert ("en" if (i, t) in letters else "und") in by[i]
    assert all(0 <= r.score <= 1 for r in rows)
    import zlib
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert language.identify(no_docs).collect() == []
    unlearned = language.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_prototypes_equal_the_sum_of_texts(llm):
    docs = [(1, "Aber das Haus", "de"), (2, "das ist gut", "de"), (3, "the house", "en"), (4, "ça va très bien", "fr")]
    learned = language.learn(llm.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3))
    for lang in ("de", "en", "fr"):
        expected = 0
        for _, text, own in docs:
            if own == lang:
                s = language.symbol_of_code()[[ord(c) for c in f" {text.lower()} "]]
                first, second, third = language.letter_vectors()
                expected = expected + sum(first[a].astype(int) * second[b] * third[c] for a, b, c in zip(s, s[1:], s[2:]))
        assert (learned[lang] == expected).all()


def test_held_out_accuracy(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs, ("doc_id", "lang")).filter("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 200 and right / len(rows) > 0.97
