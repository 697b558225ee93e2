from __future__ import annotations

import random
import re

import pytest

from tests_llm_rows import ROWS
from winnow.llm import licenses
from winnow.llm.queries import op12_licenses


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def least_errors(notice, line):
    """Edit distance of the notice to the nearest stretch of whole words of a line (Sellers' table, starts at borders)."""
    if not line:
        return len(notice)
    column = list(range(len(notice) + 1))  # before the first letter: a border
    best = 10**6
    for at, c in enumerate(line):
        new = [column[0] + 1]
        for i, n in enumerate(notice, 1):
            new.append(min(column[i - 1] + (n != c), column[i] + 1, new[i - 1] + 1))
        # a match may begin at any border: an empty prefix costs nothing there
        if c == " ":
            new = [min(a, b) for a, b in zip(new, range(len(notice) + 1))]
        column = new
        if at + 1 == len(line) or line[at + 1] == " ":
            best = min(best, column[-1])
    return best


def brute_labels(text, notices, letters, most):
    line = " ".join(words(text))
    return {label for notice, label in notices.items()
            if line and least_errors(notice, line) <= min(len(notice) // letters, most)}


def brute_base(text):
    w = words(text)
    return sorted((at, label) for phrase, label in licenses.BASE.items() for at in range(len(w))
                  if w[at:at + len(phrase.split())] == phrase.split())


def expected(doc_id, text):
    base = brute_base(text)
    known = sorted({label for _, label in base})
    both = sorted({*known, *brute_labels(text, licenses.NOTICES, licenses.LETTERS_PER_ERROR, licenses.MOST_ERRORS)})
    return (str(doc_id), len(words(text)), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(known), ",".join(both))


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
                  for r in df.collect())


NOTES = [
    "Released under the MIT licence.", "GNU General\nPublic-License!", "cc by cc by", "the permit license", "MIT-License, Apache License",
    "relesed under teh MIT License", "xmit license", "mit licenses", "mit licensesx", "apache licens", "gnu genral public licnse",
    "licensed under CC BY-NC 4.0", "mit license " * 50, "Permision is hereby granted, free of charge, to any persn obtaining a copy of this software",
    "mit lich kein license", "gnu lesser general public license", "apache2license apacheXlicense", "mit  ünder license", "mitlicense",
]


def test_odd_documents(llm, odd_docs, no_docs):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(NOTES)]
    extra = llm.createDataFrame([(100 + i, t) for i, t in enumerate(NOTES)], "doc_id long, text string")
    got = licenses.license_labels(odd_docs.select("doc_id", "text", "n", "start").unionByName(extra, allowMissingColumns=True))
    assert rows_of(got) == sorted((expected(*r) for r in rows), key=lambda r: (r[0], r[1], r[2:]))
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got.collect())
    assert licenses.license_labels(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_damaged_notices_equal_an_edit_table(seed):
    r = random.Random(seed)
    notices = {"gnu general public license": "gpl", "mit license": "mit", "this is free and unencumbered software": "un", "aa aa aa aa aa": "a"}
    scanner = licenses.Scanner(notices, {}, 8, 4)
    for _ in range(150):
        line = [r.choice(["mit", "lich", "gnu", "public", "aa", "x", "license"]) for _ in range(r.randint(0, 6))]
        for _ in range(r.randint(0, 2)):
            text = list(r.choice(list(notices)))
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(text))
                text[at:at + r.choice([0, 1, 1])] = r.choice(["", "x", " ", "e"])
            line.insert(r.randint(0, len(line)), "".join(text))
        text = " ".join(line)
        _, spans = scanner.scan(licenses.word_line(text))
        assert {s.label for s in spans} == brute_labels(text, notices, 8, 4), text
        w = words(text)
        for s in spans:
            assert 0 <= s.first < s.end <= len(w)
            assert least_errors(s.notice, " ".join(w[s.first:s.end])) <= s.errors <= min(len(s.notice) // 8, 4)


def test_pieces_cover_a_notice():
    for errors in range(5):
        parts = licenses.pieces("gnu general public license", errors)
        assert len(parts) == errors + 1 and "".join(p for _, p in parts) == "gnu general public license"


def test_repeated_seeds_take_linear_time():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.BASE)
    exact, spans = scanner.scan(licenses.word_line("mit licen " * 20_000 + "mit license"))
    assert exact == [(40_000, "mit")] and len(spans) > 0


def test_registered_query_equals_brute_force(llm):
    folder = "/root/testdata/sf0.001"
    docs = llm.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    texts = {}
    for d in docs:
        if d.text not in texts:
            near = re.search("licen|cc by|apache|gnu|mit l|permission|creative|redistrib|mozilla|eclipse|public", " ".join(words(d.text)))
            texts[d.text] = expected(0, d.text)[1:] if near and len(d.text or "") < 20_000 else None
    got = {r[0]: r[1:] for r in rows_of(op12_licenses(llm, folder))}
    assert len(got) == len(docs)
    for d in docs:
        if texts[d.text] is not None:
            assert got[str(d.doc_id)] == texts[d.text]
        else:
            base = brute_base(d.text)
            assert got[str(d.doc_id)][:2] == (len(words(d.text)), len(base))
