from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_rows import ROWS
from winnow.llm import suffixes


def brute(docs):
    rows = [(suffixes.LAST_ID if i is None else i, i, (t or "").encode()) for i, t in docs]
    least = defaultdict(lambda: suffixes.LAST_ID + 1)
    for order, _, b in rows:
        for s in range(len(b) - 49):
            least[b[s:s + 50]] = min(least[b[s:s + 50]], order)
    out = []
    for order, doc_id, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s:s + 50]] < order:
                gone[s:s + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def documents(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.choice([2, 3, 6])))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (9, 12, 14, 25, 60)] + ["x" * 120, "ab" * 40, "é" * 26]
    docs = []
    for k in range(120):
        parts = [text(r.choice([0, 1, 5, 20])) for _ in range(3)]
        for _ in range(r.choice([0, 1, 2])):
            p = r.choice(passages)
            a = r.choice([0, 0, 3, 11])
            parts.insert(r.randrange(4), p[a:] if r.random() < 0.7 else p[:-a or None])
        docs.append((k * 7 % 120, r.choice(["", " "]).join(parts)))
    docs += [(500 + k, docs[3][1]) for k in range(6)] + [(600, docs[5][1] + "tail" * 20), (None, docs[8][1]), (None, docs[5][1])]
    return docs + [docs[0], docs[0], (docs[1][0], text(30) + passages[4])]


@pytest.mark.parametrize("seed,crowd", [(1, 100_000), (2, 100_000), (3, 3)])
def test_removal_equals_brute_force(llm, seed, crowd):
    docs = documents(seed)
    table = llm.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, place int, mark string").repartition(5)
    assert result(suffixes.remove_repeats(table, crowd=crowd)) == brute(docs)


def test_runs_inside_a_text_count_as_suffixes(llm):
    docs = [(1, "head " + "-" * 6000 + " mid " + "=." * 900), (2, "a line " + "-" * 70), (3, "=." * 40 + "z" + "-" * 3000),
            (4, "alone " + "#" * 9000)]
    table = llm.createDataFrame(docs, "doc_id long, text string").repartition(2)
    texts = table.selectExpr("doc_id as id", "xxhash64(text) as mark", "cast(text as binary) as body")
    shared = suffixes.shared_anchors(texts)
    dashes, h = suffixes.anchors(np.frombuffer(b"-" * 60, np.uint8))
    crowds = {r.part for r in suffixes.crowded_anchors(shared, 5000).collect()}
    assert crowds == {int(h[0]) & suffixes.HASH}  # three texts, some 9,000 suffixes; what one text has is no crowd
    hashes = shared.filter("times is null").groupBy("mark").agg(F.collect_list("hashes").alias("hashes"))
    assert suffixes.suffixes(texts.join(hashes, "mark")).count() < 600  # equal surroundings in a run are one row
    for crowd in (5000, 3, 100_000):
        assert result(suffixes.remove_repeats(table, crowd=crowd)) == brute(docs)


def test_odd_documents(llm, odd_docs, no_docs):
    assert result(suffixes.remove_repeats(odd_docs)) == brute(ROWS)
    assert suffixes.remove_repeats(no_docs).collect() == []


def test_kept_bytes(llm):
    shared = "a passage that stands in both documents and is longer than fifty bytes"
    rows = suffixes.remove_repeats(llm.createDataFrame(
        [(1, shared), (2, f"before {shared} after")], "doc_id long, text string"), keep=True).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] is None and kept[2] == "before  after"


def test_anchors_depend_on_the_match_alone():
    r = np.random.default_rng(4)
    match = r.integers(97, 101, 50).astype(np.uint8)
    seen = []
    for _ in range(40):
        a, z = r.integers(97, 101, r.integers(0, 90)).astype(np.uint8), r.integers(97, 101, 60).astype(np.uint8)
        places, hashes = suffixes.anchors(np.concatenate([a, match, z]))
        seen.append({(p - len(a), h) for p, h in zip(places.tolist(), hashes.tolist()) if 0 <= p - len(a) <= 26})
    assert set.intersection(*seen)


def test_interval_tree_is_the_stack_scan_of_all_prefix_groups():
    words = sorted(["banana", "band", "bandit", "ban", "car", "cart", "banana"])
    lcp = np.array([0] + [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(words, words[1:])])
    found = {tuple(t) for t in suffixes.interval_tree(lcp, 1).tolist()}
    expected = set()
    for a in range(len(words)):
        for z in range(a + 2, len(words) + 1):
            shared = min(lcp[a + 1:z])
            if shared >= 1 and (a == 0 or lcp[a] < shared) and (z == len(words) or lcp[z] < shared):
                expected.add((shared, a, z))
    assert found == expected


def test_repeats_are_maximal_and_have_all_occurrences():
    core = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"  # 50 bytes
    texts = [b"P" * 26 + core + b"1" * 26, b"P" * 26 + core + b"2" * 26, b"Q" * 26 + core + b"3" * 26]
    around = np.array([np.frombuffer(t[4:4 + 76], np.uint8) for t in texts])  # anchor at 30
    n = np.array([26] * 3), np.array([50] * 3)
    repeat, member, left, length = suffixes.repeat_groups(
        np.zeros(3, np.int64), around[:, 25::-1], n[0], around[:, 26:], n[1])
    by = defaultdict(set)
    for g, m, a, b in zip(repeat.tolist(), member.tolist(), left.tolist(), length.tolist()):
        by[g].add((m, a, b))
    assert sorted(map(sorted, by.values())) == [[(0, 4, 50), (1, 4, 50), (2, 4, 50)], [(0, 26, 72), (1, 26, 72)]]


def test_anchors_settled_in_small_ranges(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(30)]
    rows = [(i, texts[i % 30] + texts[(i * 7 + 1) % 30][:150] + str(i)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, suffixes.remove_repeats(docs).collect()))
    monkeypatch.setattr(suffixes, "RANGE_ROWS", 20)
    monkeypatch.setattr(suffixes, "SETTLED_ROWS", 50)
    assert sum(row[2] for row in whole) > 0
    assert sorted(map(tuple, suffixes.remove_repeats(docs).collect())) == whole


def test_a_text_is_one_row_however_many_tasks_settle_its_anchors(llm, monkeypatch):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=3000))
    docs = [(i, str(i) + passage) for i in range(40)]
    texts = llm.createDataFrame(docs, "id long, body string").repartition(4).selectExpr(
        "id", "xxhash64(body) as mark", "cast(body as binary) as body")
    monkeypatch.setattr(suffixes, "SETTLED_ROWS", 500)
    kept = llm.conf.get("spark.sql.shuffle.partitions")
    try:
        llm.conf.set("spark.sql.shuffle.partitions", "24")
        rows = suffixes.shared_anchors(texts).filter("times is null").collect()
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", kept)
    _, hashes = suffixes.anchors(np.frombuffer(passage.encode(), np.uint8))
    inside = set((hashes & np.uint64(suffixes.HASH)).tolist())
    assert len(rows) == len({r.mark for r in rows}) == 40
    assert all(inside <= set(np.frombuffer(r.hashes, "<u8").tolist()) for r in rows)
