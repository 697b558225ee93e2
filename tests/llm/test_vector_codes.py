from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import vector_codes as vc


def plain_nearest(parts, entries):
    distance = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return distance.argmin(axis=1), distance.min(axis=1)  # argmin takes the first of equals


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_a_full_search(seed):
    r = np.random.default_rng(seed)
    spread = [2, 3, 50, 1000, 10, 1 << 27][seed]
    entries = r.integers(-spread, spread, (40, 4))
    entries[10:14] = entries[3]  # equal entries: the lower index wins
    parts = np.vstack([r.integers(-spread, spread, (300, 4)), entries])
    found, best, computed = vc.nearest(parts, entries)
    index, distance = plain_nearest(parts, entries)
    assert (found == index).all() and (best == distance).all()
    assert computed <= len(parts) * len(entries)


def test_search_leaves_far_sums_alone():
    entries = np.arange(64)[:, None] * np.full((1, 4), 100)
    _, _, computed = vc.nearest(np.repeat(entries, 5, axis=0) + 1, entries)
    assert computed <= 3 * 64 * 5


def brute(rows, parts, entries, rounds, scale):
    kept = [(i, l, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, l in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for *_, v in kept), default=0) // parts))
    most = min(1 << 27, (1 << 29) // width)
    kept = [(i, l, [max(-most, min(most, x)) for x in v] + [0] * (parts * width - len(v)), v) for i, l, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2][:len(r[3])], "<i8").tobytes()))[:entries]
    books = [[f[2][p * width:(p + 1) * width] for f in first] for p in range(parts)]

    def assign():
        out = []
        for _, _, v, _ in kept:
            row = []
            for p in range(parts):
                x = v[p * width:(p + 1) * width]
                row.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
            out.append(row)
        return out

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [k[2][p * width:(p + 1) * width] for k, c in zip(kept, chosen) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    chosen = assign()
    total = {}
    for k, c in zip(kept, chosen):
        total[k[1]] = total.get(k[1], 0) + sum(d for d, _ in c)
    text = ",".join(str(x) for b in books for e in b for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted((str(k[0]), "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), total[k[1]], digest)
                  for k, c in zip(kept, chosen))


def rows_of(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def odd_rows(count=150, dims=10):
    r = random.Random(3)
    rows = [(i, [r.choice([-1.5, 0.0, 0.01, 0.9, 2.0, r.random()]) for _ in range(dims)], r.choice([0, 1, None])) for i in range(count)]
    rows += [(5, [0.5] * dims, 1), (5, [0.25] * dims, 1), (7, rows[7][1], rows[7][2]), (None, [0.1] * dims, None)]
    rows += [(900, None, 0), (901, [1.0, None], 0), (902, [float("nan")] * dims, 1), (903, [float("-inf")] * dims, 1)]
    rows += [(-4, [], 0), (904, [1.0, 2.0], 2), (905, [3e38] * dims, 2), (906, [-3e38] * dims, 3)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, data string, code int, part int, error string"


def test_odd_vectors_equal_brute_force(llm):
    rows = odd_rows()
    table = llm.createDataFrame([(*r, "x", 1, 2, "e") for r in rows], SCHEMA).repartition(3)
    codes, books = vc.compress(table, parts=4, entries=9, rounds=2)
    assert rows_of(codes) == brute(rows, 4, 9, 2, 256)
    again, _ = vc.compress(table.repartition(7), parts=4, entries=9, rounds=2)
    assert rows_of(again) == rows_of(codes)
    decoded = vc.decode([r.code for r in codes.select("code").limit(5).collect()], books)
    assert decoded.shape == (5, 12)


def test_few_rows_and_none(llm):
    rows = odd_rows(8, 4)[:3]
    table = llm.createDataFrame([(*r, "x", 1, 2, "e") for r in rows], SCHEMA)
    assert rows_of(vc.compress(table)[0]) == brute(rows, 16, 64, 2, 256)
    assert vc.compress(table.limit(0))[0].collect() == []


def test_labels_beyond_the_broadcast_bound(llm):
    coded = llm.createDataFrame([(i, "00", i, None if i % 3 else i % 2) for i in range(60)],
                                "vec_id long, code string, error long, label int")
    few = vc.with_label_error(coded, "label")
    many = vc.with_label_error(coded, "label", broadcast_labels=0)
    assert sorted(few.collect(), key=str) == sorted(many.collect(), key=str) and few.count() == 60
    assert few.filter(F.col("label").isNull()).first().label_error == sum(i for i in range(60) if i % 3)


def test_whole_table_equals_brute_force(llm):
    table = llm.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()][:200]
    codes, _ = vc.compress(llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert rows_of(codes) == brute(rows, 16, 64, 2, 256)
