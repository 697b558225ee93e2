"""Finding project descriptions in a resume, inside its row.

Arguments named ``lines`` must be columns of the input (see ``sections.segments``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed
from winnow.functions import sections
from winnow.functions.common import found, is_blank, join_lines, let, numbered, pattern, strip


def starts_project(lines: Column, at: Column) -> Column:
    """Whether the non-blank line at ``at`` opens a project: bullet, year range, or a title after a blank line."""
    small = F.array(*[F.lit(w) for w in fixed.TITLE_SMALL_WORDS])

    def decide(line: Column) -> Column:
        marked = (found(line, fixed.PROJECT_BULLET, ignore_case=True)
                  | found(line, fixed.PROJECT_YEAR_RANGE, ignore_case=True))

        def mostly_capitals(words: Column) -> Column:
            capital = F.filter(words, lambda w: F.array_contains(small, F.lower(w)) | w.rlike(r"^\p{Lu}"))
            return (F.size(words) >= 2) & (F.size(capital) >= F.size(words) * F.lit(fixed.TITLE_MIN_SHARE))

        titled = ((F.length(line) < fixed.TITLE_MAX_CHARS) & after_gap(lines, at)
                  & let(F.split(line, pattern(r"\s+")), mostly_capitals))
        return marked | titled

    return let(strip(F.get(lines, at)), decide)


def after_gap(lines: Column, at: Column) -> Column:
    """True for the first line and for a line below a blank one."""
    return (at == 0) | is_blank(F.get(lines, at - 1))


def opening_lines(lines: Column) -> Column:
    """Places of the lines where a project begins."""
    places = F.transform(lines, lambda line, at: F.when(
        ~is_blank(line) & (after_gap(lines, at) | starts_project(lines, at)), at))
    return F.filter(places, lambda at: at.isNotNull())


def split_projects(lines: Column, openings: Column) -> Column:
    """Project texts between ``openings``, blank lines dropped, too short ones dropped."""

    def text(at: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(openings, j + 1), F.size(lines))
        return join_lines(F.filter(F.slice(lines, at + 1, stop - at), lambda line: ~is_blank(line)))

    return F.filter(F.transform(openings, text), lambda t: F.length(strip(t)) > fixed.MIN_PROJECT_CHARS)


def chunks(lines: Column) -> Column:
    """Non-blank lines cut into pieces, each ending with the line that takes it past the chunk size."""

    def cut(filled: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("run"), F.array().cast("array<int>").alias("cuts"),
                         F.lit(0).alias("at"))

        def add(acc: Column, line: Column) -> Column:
            run = acc["run"] + F.length(line)
            full = run > fixed.PROJECT_CHUNK_CHARS
            return F.struct(
                F.when(full, F.lit(0).cast("bigint")).otherwise(run).alias("run"),
                F.when(full, F.concat(acc["cuts"], F.array(acc["at"] + 1))).otherwise(acc["cuts"]).alias("cuts"),
                (acc["at"] + 1).alias("at"))

        def slices(cuts: Column) -> Column:
            ends = F.when(F.get(cuts, F.size(cuts) - 1) == F.size(filled), cuts).otherwise(
                F.concat(cuts, F.array(F.size(filled))))
            return let(F.when(F.size(cuts) == 0, F.array(F.size(filled))).otherwise(ends), lambda e: F.transform(
                e, lambda end, j: let(F.coalesce(F.get(e, j - 1), F.lit(0)), lambda begin: join_lines(
                    F.slice(filled, begin + 1, end - begin)))))

        return let(F.aggregate(filled, start, add)["cuts"], slices)

    return let(F.filter(lines, lambda line: ~is_blank(line)), cut)


def section_projects(projects_text: Column, lines: Column, split: Column) -> Column:
    """Split projects, or chunks of one giant project, or the whole section as a project."""
    size = F.length(strip(projects_text))
    return (
        F.when((F.size(split) <= 1) & (size > fixed.PROJECT_CHUNK_CHARS), chunks(lines))
        .when((F.size(split) == 0) & (size > fixed.MIN_PROJECT_CHARS), F.array(projects_text))
        .otherwise(split)
    )


def block_events(lines: Column) -> Column:
    """Lines that open a project block (``opens``) or end one, in order, as structs ``(at, opens)``."""
    events = F.transform(lines, lambda line, at: F.struct(
        at.alias("at"),
        F.when(found(strip(line), fixed.PROJECT_OPENING, ignore_case=True), F.lit(True))
        .when(sections.standalone_heading(line).isNotNull(), F.lit(False)).alias("opens")))
    return F.filter(events, lambda e: e["opens"].isNotNull())


def block_projects(lines: Column, events: Column) -> Column:
    """Texts from each opening line to the next event, for resumes without a projects section."""
    spans = F.transform(events, lambda e, j: F.struct(
        e["opens"].alias("opens"), e["at"].alias("at"),
        F.coalesce(F.get(events, j + 1)["at"], F.size(lines)).alias("stop")))
    opened = F.filter(spans, lambda s: s["opens"])
    return F.transform(opened, lambda s: join_lines(F.slice(lines, s["at"] + 1, s["stop"] - s["at"])))


