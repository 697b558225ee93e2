"""Splitting a resume into sections, inside the row that holds it.

A resume is one row and its sections never need a line of another row, so everything here is array work on that
row: no explode, no shuffle, and no group that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed
from winnow.functions.common import empty_texts, found, found_any, join_lines, nested, numbered, strip


def _any_of(phrases) -> str:
    return "(?:" + "|".join(phrase.replace(" ", r"\s*") for phrase in phrases) + ")"


def standalone_pattern(section: str) -> str:
    return r"^\s*" + _any_of(fixed.STANDALONE_HEADINGS[section]) + r"\s*:?\s*$"


def inline_pattern(section: str) -> str:
    return r"^\s*" + _any_of(fixed.INLINE_HEADINGS[section]) + r"\s*:\s*\S"


def heading_pattern() -> str:
    """Any heading at all: one test rules out almost every line."""
    def all_of(headings: dict[str, list[str]]) -> str:
        return nested([p.replace(" ", r"\s*") for phrases in headings.values() for p in phrases])

    return (rf"^\s*(?:{all_of(fixed.STANDALONE_HEADINGS)}\s*:?\s*$|"
            rf"{all_of(fixed.INLINE_HEADINGS)}\s*:\s*\S)")


def _first_match(line: Column, patterns: dict[str, str]) -> Column:
    choice = F.lit(None).cast("string")
    for section, text in reversed(list(patterns.items())):
        choice = F.when(found(line, text, ignore_case=True), F.lit(section)).otherwise(choice)
    return choice


def standalone_heading(line: Column) -> Column:
    """Section named by a heading that fills the line, else null."""
    return _first_match(line, {s: standalone_pattern(s) for s in fixed.STANDALONE_HEADINGS})


def inline_heading(line: Column) -> Column:
    """Section named by ``Heading: content``, else null. Asked only where no standalone heading matched."""
    return _first_match(line, {s: inline_pattern(s) for s in fixed.INLINE_HEADINGS})


def inline_content(line: Column) -> Column:
    """What follows the first colon, stripped."""
    return strip(F.substr(line, F.instr(line, ":") + 1))


def headings(lines: Column) -> Column:
    """Headings in order as structs ``(at, section, content)``; ``content`` is null for standalone ones."""

    def describe(h: Column) -> Column:
        line = h["item"]
        alone = standalone_heading(line)
        return F.struct(
            h["at"].alias("at"),
            F.coalesce(alone, inline_heading(line)).alias("section"),
            F.when(alone.isNull(), inline_content(line)).alias("content"),
        )

    return F.transform(numbered(lines, lambda line: found(line, heading_pattern(), ignore_case=True)), describe)


def segments(lines: Column, heads: Column) -> Column:
    """Runs of lines under one heading as structs ``(section, body)``, the part before any heading being ``other``.

    ``lines`` and ``heads`` must be columns of the input, not expressions: they are read once per heading.
    """
    opening = F.array(F.struct(
        F.lit(-1).alias("at"), F.lit("other").alias("section"), F.lit(None).cast("string").alias("content")))

    def run(head: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(heads, j)["at"], F.size(lines))
        rest = F.slice(lines, head["at"] + 2, stop - head["at"] - 1)
        own = F.when(head["content"].isNull(), empty_texts()).otherwise(F.array(head["content"]))
        return F.struct(head["section"].alias("section"), F.concat(own, rest).alias("body"))

    return F.transform(F.concat(opening, heads), run)


def section_lines(segs: Column, section: str) -> Column:
    chosen = F.filter(segs, lambda s: s["section"] == section)
    return F.flatten(F.transform(chosen, lambda s: s["body"]))


def section_text(segs: Column, section: str) -> Column:
    return join_lines(section_lines(segs, section))


def is_education(text: Column) -> Column:
    return found_any(F.lower(text), fixed.EDUCATION_CONTEXT)


def is_project(text: Column) -> Column:
    return found_any(F.lower(text), fixed.PROJECT_CONTEXT)


def is_work(text: Column) -> Column:
    return found_any(F.lower(text), fixed.WORK_CONTEXT)


def context_window(lines: Column, at: Column, reach: int = 3) -> Column:
    """The line at ``at`` with up to ``reach`` neighbours on each side, joined by blanks."""
    first = F.greatest(at - reach, F.lit(0))
    last = F.least(at + reach + 1, F.size(lines))
    return F.array_join(F.slice(lines, first + 1, last - first), " ")
