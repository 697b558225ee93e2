from __future__ import annotations

import hashlib
import io
import zlib
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from winnow.llm import sharding, warc


def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_odd_documents(odd_docs):
    rows = sharding.shard_documents(odd_docs, 4).collect()
    check_shards(rows, 4)
    texts = [(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len(t) + 8, zlib.crc32(t)) for i, t in texts)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_no_documents(no_docs):
    assert sharding.shard_documents(no_docs).collect() == []


@pytest.mark.parametrize("slice_rows", [7, 200_000])
def test_hot_key_and_columns_kept(llm, slice_rows):
    rows = llm.createDataFrame([(None if i % 3 == 0 else i % 50, i) for i in range(600)], "k long, slot int")
    placed = sharding.shard_rows(rows.withColumnRenamed("slot", "v"), "k", 5, 16, slice_rows).collect()
    check_shards(placed, 5)
    assert sorted(r.v for r in placed) == list(range(600))


@pytest.mark.parametrize("slice_rows", [5, 1000])
def test_shards_do_not_depend_on_the_layout(llm, slice_rows):
    rows = llm.createDataFrame([(i if i % 4 else i % 8, i % 300) for i in range(3000)], "k long, v int")
    here, there = (sharding.shard_rows(part, "k", 7, 16, slice_rows) for part in (
        rows.repartition(2), rows.orderBy(F.desc("v")).repartition(9)))
    assert Counter(here.collect()) == Counter(there.collect())
    assert Counter(sharding.shard_rows(rows, "k", 7, 16, 200_000).collect()) == Counter(here.collect())


def sequential(loads, owners, capacity):
    """Fill own shards first, then carry what is over clockwise, one key at a time."""
    room, place = list(capacity), {}
    over = []
    for arc, load in enumerate(loads):
        for k in range(load):
            if room[owners[arc]]:
                room[owners[arc]] -= 1
                place[arc, k] = owners[arc]
            else:
                over.append((arc, k))
    for arc, k in over:
        node = arc
        while not room[owners[node % len(loads)]]:
            node += 1
        room[owners[node % len(loads)]] -= 1
        place[arc, k] = owners[node % len(loads)]
    return place


def test_spill_equals_one_key_at_a_time():
    import random

    for seed in range(60):
        r = random.Random(seed)
        owners = [r.randrange(4) for _ in range(12)] + [0, 1, 2, 3]
        loads = [r.choice([0, 0, 1, 3, 40]) for _ in owners]
        total = sum(loads)
        capacity = [total // 4 + (s < total % 4) for s in range(4)]
        runs = sharding.spill_plan(loads, owners, capacity)
        assert {(a, k): s for a, lo, hi, s in runs for k in range(lo, hi)} == sequential(loads, owners, capacity)


def test_a_key_moves_only_by_overflow_or_to_the_new_shard(llm):
    rows = llm.range(20_000).withColumnRenamed("id", "k")
    four, five = ({r.k: r.shard for r in sharding.shard_rows(rows, "k", n).collect()} for n in (4, 5))
    moved = [k for k in four if four[k] != five[k]]
    assert len(moved) < 0.45 * len(four)  # a fifth must move; plain modulo moves four fifths


PAGES = [
    (5, "http://a", "x" * 100), (3, "http://b", "x" * 100), (9, None, "x" * 100), (None, "u", "x" * 100),
    (1, "c", "y" * 99), (2, "d", "y" * 99), (4, "e\r\nInjected: 1", None), (6, "f", ""), (7, "g", "é" * 60 + "\r\n\r\nbody"),
    (8, "h", "é" * 60 + "\r\n\r\nbody"), (10, "i", "z" * 3_000_000), (11, "j", "t" * 200), (11, "j", "t" * 200),
    (12, "k", "t" * 200), (None, "l", "only null ids" * 20), (None, "m", "only null ids" * 20),
]


def test_archives_give_every_page_back(llm):
    pages = llm.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id long, url string, html string, bytes int, digest string")
    rows = warc.round_trip(llm, pages).collect()
    expected = Counter()
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None) if len(data) >= 100 else None
        again = first is not None and page != first
        expected[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                  first if again else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected


def test_revisits_name_records_that_exist(llm):
    pages = llm.createDataFrame(PAGES, "page_id long, url string, html string")

    def heads():
        found = []
        for row in warc.archive_pages(pages).collect():
            with open(row.path.removeprefix("file:"), "rb") as stream:
                found += [warc.parse(data)[0] for data in warc.frames(stream)]
        return found

    first = heads()
    responses = {h["warc-record-id"]: h.get("page-id") for h in first if h["warc-type"] == "response"}
    revisits = [h for h in first if h["warc-type"] == "revisit"]
    assert len(revisits) == 5
    assert all(responses[h["warc-refers-to"]] == h["refers-to-page-id"] for h in revisits)
    named = [sorted(h["warc-record-id"] for h in found if "page-id" in h) for found in (first, heads())]
    assert named[0] == named[1] and len(set(named[0])) == len(named[0]) - 1  # one row is repeated


def test_no_pages(llm):
    pages = llm.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(llm, pages).collect() == []


def test_archives_roll_and_records_stand_alone(llm, tmp_path):
    rows = [(i, f"http://p/{i}", f"<p>some page {i} of a site, mostly the same as any other</p>" * 20) for i in range(400)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    dictionary = warc.train_dictionary(pages, "html")
    from pyspark.sql import functions as F
    ready = pages.select("page_id", "url", F.col("html").cast("binary").alias("payload"),
                         F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("digest"),
                         F.lit(None).cast("long").alias("refers_to"))
    archives = warc.write_archives(ready, f"file://{tmp_path}", dictionary, archive_bytes=100_000).collect()
    assert sum(a.records for a in archives) == 400 and len(archives) > 4
    data = open(archives[0].path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME and len(data) == archives[0].size
    size = int.from_bytes(data[4:8], "little")
    held = zstandard.ZstdDecompressor().decompress(data[8:8 + size])
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).decompressobj()
    assert alone.decompress(data[8 + size:]).startswith(b"WARC/1.1\r\n") and alone.eof
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-3])))


def test_many_copies_and_empty_pages_leave_a_dictionary(llm, caplog):
    page = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.hex(F.xxhash64(k, F.col("id") % 30) % 5000)))
    pages = llm.range(30_000).select(F.when(F.col("id") % 3 > 0, page).when(F.col("id") % 2 == 0, "").alias("html"))
    assert len(warc.train_dictionary(pages, "html", rows=20, size=4096)) > 0
    assert warc.train_dictionary(pages.filter("html = ''"), "html") == b""
    assert "without a dictionary" in caplog.text


def test_small_corpus_has_no_dictionary(llm):
    assert warc.train_dictionary(llm.createDataFrame([("a",)], "html string"), "html") == b""
