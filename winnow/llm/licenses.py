"""License scan: fuzzy search for short notices.

Texts and notices are compared as words, lower-cased in A-Z and joined by single spaces. A notice of n letters may differ
by up to n // ``letters_per_error`` letters (inserted, dropped or exchanged), ``most_errors`` at most. It is split into one piece more than that;
errors cannot touch every piece, so wherever the notice stands, some piece stands exactly (pigeonhole). One automaton
finds all pieces of all notices in a text; a piece found at some place leaves a narrow window where its notice can be
(places that may be one occurrence share one), and in each the regex library's bounded-error matching verifies the edits and
gives the span. Spans begin and end at word borders; of a notice's spans that overlap, one with least errors stays.

Phrases that must stand exactly (the base) are found by the same automaton, as whole words.

A row is worked on by itself: no shuffle, one document in memory at a time, work in proportion to its text. Null and empty
texts have no words. Documents without an id, repeated rows and ties are rows of their own. An empty table gives no rows.
Columns named in ``carry`` are kept, others ignored; names of the result may clash with those of ``docs``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import lean

# What is not part of a word is a space; A-Z are small letters. Other letters are two bytes or more, which stay.
TABLE = bytes(0x20 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 * (0x41 <= c <= 0x5A)
              for c in range(256))
SPACES = re.compile(" {2,}")
LETTERS_PER_ERROR, MOST_ERRORS = 10, 3

# Phrases that count where they stand exactly, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices searched with errors, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache",
    "apache license": "apache",
    "apache software license": "apache",
    "mit license": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


@dataclass(frozen=True)
class Span:
    """A notice in a text: its errors and the words it covers (``first`` up to but not including ``end``)."""

    label: str
    notice: str
    errors: int
    first: int
    end: int


def word_line(text: str | None) -> str:
    """The words of a text with a space before, between and after them; one space if there are none."""
    return SPACES.sub(" ", f" {(text or '').encode().translate(TABLE).decode()} ")


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces that make up the notice, with their places."""
    count = errors + 1
    cuts = [len(notice) * i // count for i in range(count + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Exact phrases and fuzzy notices of one list, searched together."""

    def __init__(self, notices: dict[str, str], base: dict[str, str], letters_per_error: int = LETTERS_PER_ERROR,
                 most_errors: int = MOST_ERRORS):
        self.notices, seeds = [], {}
        for number, (text, label) in enumerate(notices.items()):
            notice = word_line(text).strip()
            if not notice:
                raise ValueError(f"notice without words: {text!r}")
            errors = min(len(notice) // letters_per_error, most_errors)
            bounded = regex.compile(f"(?b) (?:{notice}){{e<={errors}}}(?= )")
            self.notices.append((notice, label, errors, bounded))
            for place, piece in pieces(notice, errors):
                seeds.setdefault(piece, []).append((number, place))
        phrases = {word_line(text): label for text, label in base.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in {*seeds, *phrases}:
            self.automaton.add_word(piece, (len(piece), seeds.get(piece, []), phrases.get(piece)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.verify = lru_cache(1 << 12)(self._verify)

    def scan(self, line: str) -> tuple[list[tuple[int, str]], list[Span]]:
        """Base places ``(first word, label)`` and notice spans of a word line, both in order of place."""
        exact, aligned = [], {}
        for last, (size, seeded, label) in self.automaton.iter(line) if len(self.automaton) else ():
            start = last - size + 1
            if label is not None:
                exact.append((start + 1, label))
            for number, place in seeded:
                aligned.setdefault(number, set()).add(start - place)
        found = [(*hit, number) for number, places in aligned.items() for hit in self._hits(line, number, places)]
        word = _word_numbers(line, {p for p, _ in exact} | {x for left, right, *_ in found for x in (left, right)})
        spans = [Span(self.notices[number][1], self.notices[number][0], errors, word[left], word[right] + 1)
                 for left, right, errors, number in sorted(found)]
        return [(word[p], label) for p, label in exact], spans

    def _hits(self, line: str, number: int, places: set[int]) -> list[tuple[int, int, int]]:
        """Verified ``(left, right, errors)`` of one notice; of spans that overlap, the one with least errors."""
        notice, _, errors, _ = self.notices[number]
        groups: list[list[int]] = []
        for at in sorted(places):  # places within 2 * errors of each other may be one occurrence
            if groups and at - groups[-1][0] <= 2 * errors:
                groups[-1][1] = at
            else:
                groups.append([at, at])
        hits: list[tuple[int, int, int]] = []
        for low, high in groups:
            # with the letters next to it: a span lies between two spaces
            a, b = max(1, low - errors) - 1, min(len(line) - 1, high + len(notice) + errors) + 1
            hit = self.verify(number, line[a:b])
            if hit:
                left, right, wrong = hit[0] + a, hit[1] + a, hit[2]
                if hits and left < hits[-1][1]:
                    hits[-1] = min(hits[-1], (left, right, wrong), key=lambda h: (h[2], h[0]))
                else:
                    hits.append((left, right, wrong))
        return hits

    def _verify(self, number: int, window: str) -> tuple[int, int, int] | None:
        match = self.notices[number][3].search(window)
        if match is None:
            return None
        bare = match.group().strip(" ")  # an error at the rim may be a space
        left = match.end() - len(match.group().lstrip(" "))
        return left, left + len(bare), sum(match.fuzzy_counts)


def _word_numbers(line: str, places: set[int]) -> dict[int, int]:
    """Which word each place of ``line`` lies in or ends, counted in one walk."""
    numbers, before, count = {}, 0, 0
    for place in sorted(places):
        count += line.count(" ", before, place)
        numbers[place] = count - 1
        before = place
    return numbers


def scan(docs: DataFrame, notices: dict[str, str] | None = None, base: dict[str, str] | None = None,
         letters_per_error: int = LETTERS_PER_ERROR, most_errors: int = MOST_ERRORS,
         carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, ``n_words``, ``base`` (places and labels of exact phrases) and ``spans`` (verified notices)."""
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, base, letters_per_error, most_errors)
        for batch in batches:
            counts, places, spans = [], [], []
            for text in batch.column(batch.num_columns - 1):
                line = word_line(text.as_py())
                exact, fuzzy = scanner.scan(line)
                counts.append(line.count(" ") - 1)
                places.append([{"word": w, "label": label} for w, label in exact])
                spans.append([vars(s) for s in fuzzy])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(places, BASE_TYPE), pa.array(spans, SPAN_TYPE)],
                [*batch.schema.names[:-1], "n_words", "base", "spans"])

    chosen = docs.select(*carry, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(lean(work), f"{fields}, n_words bigint, base array<struct<word:bigint,label:string>>, "
                             "spans array<struct<label:string,notice:string,errors:bigint,first:bigint,end:bigint>>")


BASE_TYPE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("errors", pa.int64()),
                                ("first", pa.int64()), ("end", pa.int64())]))


def license_labels(docs: DataFrame) -> DataFrame:
    """Per document: base places and labels, all labels, and a score: 1 for an exact phrase, else the best span's share of
    letters without error."""
    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    words = F.transform("base", lambda b: b["word"])
    exact = F.transform("base", lambda b: b["label"])
    fuzzy = F.transform("spans", lambda s: s["label"])
    share = F.array_max(F.transform("spans", lambda s: 1 - s["errors"] / F.length(s["notice"])))
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"), listed(exact).alias("base_labels"),
        listed(F.concat(exact, fuzzy)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"), "spans")
