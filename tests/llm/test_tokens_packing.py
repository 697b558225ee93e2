from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests_llm_rows import ROWS
from winnow.llm import packing, separators
from winnow.llm.common import shared_folder
from winnow.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, WORDS = Tokenizer.from_file(PATH), WordIds(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def fast(text):
    return np.frombuffer(WORDS.of((text or "").encode()), "<u4").tolist()


@pytest.mark.parametrize("text", [t for _, t in ROWS])
def test_word_ids_equal_the_library(text):
    assert fast(text) == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeétsSÀß'’., \n\t\x1c\x85 0129!*<|>-"), st.characters(codec="utf-8"))))
def test_word_ids_equal_the_library_on_any_text(text):
    assert fast(text) == ids_of(text)


def test_vocabulary_merges_to_itself():
    """What makes merging by rank alone exact: each word-end token is what its own letters merge to."""
    for token, number in list(WHOLE.get_vocab(with_added_tokens=False).items())[::7]:
        if token.endswith("</w>") and token[:-4].isascii() and token[:-4].islower() and token[:-4].isalpha():
            assert fast(token[:-4]) == [number]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_rank_once(histogram):
    bins, seen = defaultdict(list), defaultdict(list)
    for length, first, times, bin_, offset in packing.plan(histogram, 40):
        for i in range(times):
            bins[bin_ + i].append((offset, length))
            seen[length].append(first + i)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 40
    assert sorted(bins) == list(range(len(bins)))


def test_fullest_is_the_best_subset():
    import itertools

    lengths, counts = np.array([13, 11, 7, 4]), np.array([2, 1, 3, 1])
    every = [k for k, n in zip(lengths.tolist(), counts.tolist()) for _ in range(n)]
    every.remove(13)
    best = max(13 + sum(c) for n in range(len(every) + 1) for c in itertools.combinations(every, n) if 13 + sum(c) <= 31)
    chosen = packing.fullest_with(13, lengths, counts, 31)
    assert sum(k * n for k, n in chosen.items()) == best and all(n <= counts[lengths == k][0] for k, n in chosen.items())


def test_packing_of_odd_documents(odd_docs):
    rows = packing.pack_documents(odd_docs, PATH, capacity=64).collect()
    expected = Counter()
    for doc_id, text in ROWS:
        ids = np.array([*ids_of(text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at:at + 64]
            expected[(doc_id, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64
    total = sum(r.length for r in rows)
    assert len(places) <= -(-total // 64) + 2


def test_equal_lengths_are_split_into_parts(llm, odd_docs):
    pieces = packing.written(packing.token_pieces(odd_docs, PATH, 64))
    rows = packing.pack(pieces, 64, slice_rows=5).collect()
    assert len(rows) == pieces.count() == len({(r.sequence_id, r.offset) for r in rows})


def test_repeated_rows_are_split_into_parts(llm):
    docs = llm.range(600).selectExpr("cast(null as bigint) as doc_id", "'the same text' as text")
    pieces = packing.numbered(packing.token_pieces(docs, PATH, 64))
    length = pieces.head()["length"]
    sizes = [r["count"] for r in packing.in_parts(pieces, {length: 6}).groupBy("part").count().collect()]
    assert len(sizes) == 6 and sum(sizes) == 600 and max(sizes) < 200
    rows = packing.pack(pieces, 64, slice_rows=100).collect()
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows}) == 600
    assert len({r.sequence_id for r in rows}) == -(-600 // (64 // length))


def test_packing_of_no_documents(no_docs):
    assert packing.pack_documents(no_docs, PATH).collect() == []


@pytest.mark.parametrize("block,group", [(1 << 21, 1 << 10), (64, 3), (1, 2), (7, 1)])
def test_separator_scan_counts_every_document(llm, odd_docs, tmp_path, block, group):
    end, folder = 49407, f"file://{tmp_path}"
    order = separators.written(separators.write_flat(
        odd_docs.filter("doc_id is null or doc_id <> 5") if block < 7 else odd_docs, PATH, end, 2, folder, file_tokens=40))
    rows = separators.count_tokens(separators.list_files(llm, folder), end, 2, block, group).collect()
    ids = {r.path.rsplit("/", 1)[-1]: r.doc_ids for r in order.collect()}
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    expected = Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS if block >= 7 or i != 5)
    assert Counter((ids[r.path.rsplit("/", 1)[-1]][r.doc_no], r.n_tokens) for r in rows) == expected
    assert all(r.ended for r in rows)


def test_separator_scan_without_a_last_end(llm, tmp_path):
    np.array([5, 9, 9, 4, 4, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([], "<u2").tofile(tmp_path / "b.bin")
    rows = separators.count_tokens(separators.list_files(llm, f"file://{tmp_path}"), 9, 2, 2, 2).orderBy("doc_no").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in rows] == [(0, 1, True), (2, 0, True), (3, 3, False)]


def test_documents_by_id_and_none(odd_docs, no_docs):
    assert separators.count_documents(odd_docs, PATH, 49407).count() == len(ROWS)
    assert separators.count_documents(no_docs, PATH, 49407).collect() == []


def test_wide_vocabulary(llm, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {f"w{i}": i for i in range(100_000)}
    plain = Tokenizer(models.WordLevel({**words, "[UNK]": 100_000}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    plain.save(str(tmp_path / "wide.json"))
    assert separators.largest_id(str(tmp_path / "wide.json"), 5) == 100_000
    assert separators.token_width(100_000) == 4 and separators.token_width(65_535) == 2
    np.array([65_536 + 7, 7, 7, 70_000, 3, 7], "<u4").tofile(tmp_path / "flat.bin")  # would pass for an end in two bytes
    files = llm.createDataFrame([(f"file://{tmp_path}/flat.bin", 24)], "path string, length long")
    found = separators.count_tokens(files, 7, separators.token_width(100_000), block_tokens=2).orderBy("doc_no").collect()
    assert [(r.n_tokens, r.ended) for r in found] == [(1, True), (0, True), (2, True)]


def test_narrow_files_refuse_wide_ids(llm):
    docs = llm.createDataFrame([(1, "plain words of text")], "doc_id long, text string")
    folder = shared_folder(llm, "narrow")
    with pytest.raises(Exception, match="does not fit"):
        separators.write_flat(docs, PATH, 49407, 1, folder).collect()
    files = separators.write_flat(docs.unionByName(docs).coalesce(1), PATH, 49407, 2, folder, file_docs=1).collect()
    assert [len(f.doc_ids) for f in files] == [1, 1]
