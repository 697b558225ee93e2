from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests_llm_rows import ROWS
from winnow.llm import simhash
from winnow.llm.components import star_components


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, limit=3):
    """Smallest member reachable, by comparing everything."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_odd_documents(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    prints = [plain_fingerprint(t) for _, t in ROWS]
    root = plain_components(prints)
    least = defaultdict(list)
    for (i, _), r in zip(ROWS, root):
        least[r].append(i)
    expected = sorted((str(i), f"{p:016x}", str(min((x for x in least[r] if x is not None), default=None)))
                      for (i, _), p, r in zip(ROWS, prints, root))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == expected
    assert simhash.near_duplicates(no_docs).collect() == []


def clusters(seed, n, spread):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(n // 20)]
    out = set()
    while len(out) < n:
        p = r.choice(centres)
        for _ in range(r.randrange(spread)):
            p ^= 1 << r.randrange(64)
        out.add(p)
    return sorted(out)


@pytest.mark.parametrize("node_rows", [4, 2048])
def test_links_equal_comparing_all(llm, node_rows):
    prints = clusters(7, 600, 9)
    table = llm.createDataFrame([(simhash.signed(p),) for p in prints], "print bigint")
    rows = star_components(simhash.links(table, 3, node_rows)).collect()
    label = {p: p for p in prints} | {r.node % (1 << 64): r.root % (1 << 64) for r in rows}
    groups = defaultdict(set)
    for p in prints:
        groups[label[p]].add(p)
    root = plain_components(prints)
    expected = defaultdict(set)
    for p, x in zip(prints, root):
        expected[x].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_dense_node_keeps_only_what_connects():
    base = np.uint64(0x0123456789ABCDEF)
    entries = np.unique(base ^ (np.arange(5000, dtype=np.uint64) << np.uint64(20)))
    a, b = simhash.node_links(entries, np.zeros(len(entries), np.int64), 3)
    assert len(a) == len(entries) - 1
    assert len(set(a.tolist())) == len(a)


def test_groups_are_pruned():
    r = np.random.default_rng(3)
    entries = np.sort(r.integers(0, 1 << 63, 4000).astype(np.uint64))
    forest = simhash.Forest(entries, np.zeros(4000, np.int64))
    assert len(forest.levels) > 3
    who, node = forest.near(np.arange(4000), 3)
    assert set(zip(who.tolist(), node.tolist())) >= {(i, i) for i in range(4000)}


def test_components_of_a_path_a_star_and_nothing(llm):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    table = llm.createDataFrame(edges, "u long, v long")
    rows = {r.node: r.root for r in star_components(table).collect()}
    assert rows == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(300)}
    assert star_components(table.limit(0)).collect() == []
