"""Scalar features of a resume: contact, experience, education, certificates, name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed
from winnow.functions import sections
from winnow.functions.common import found, found_any, let, nested, numbered, pattern, strip, text_lines


# --- contact -----------------------------------------------------------------------------------------------------

def has_contact(text: Column) -> Column:
    lowered = F.lower(text)
    contact = found(lowered, fixed.EMAIL) | lowered.rlike(fixed.PHONE) | lowered.contains(fixed.LINKEDIN)
    return F.coalesce(contact, F.lit(False)).cast("int")


# --- years of experience -------------------------------------------------------------------------------------------

def _stated(lowered: Column, text: str) -> Column:
    """First stated number of years, capped; null if none is stated. Numbers too long for a BIGINT hit the cap."""
    digits = F.regexp_extract(lowered, pattern(text), 1)
    return F.when(digits != "", F.least(F.coalesce(digits.try_cast("bigint"), F.lit(fixed.MAX_YEARS)),
                                        F.lit(fixed.MAX_YEARS)).cast("int"))


def stated_years_in_work(work_text: Column) -> Column:
    return _stated(F.lower(work_text), fixed.WORK_SECTION_YEARS)


def stated_years_anywhere(text: Column) -> Column:
    return _stated(F.lower(text), fixed.FREE_TEXT_YEARS)


def range_years(lowered: Column, as_of_year: int) -> Column:
    """Sum of all year ranges in a text, uncapped; overlaps count twice and reversed ranges count nothing."""
    dates = F.lit(pattern(fixed.YEAR_RANGE))
    starts = F.regexp_extract_all(lowered, dates, 1)
    ends = F.regexp_extract_all(lowered, dates, 2)

    def years(start: Column, end: Column) -> Column:
        until = F.when(end.isin(fixed.OPEN_ENDS), F.lit(as_of_year)).otherwise(end.try_cast("int"))
        return F.greatest(until - start.cast("int"), F.lit(0)).cast("bigint")

    return F.aggregate(F.zip_with(starts, ends, years), F.lit(0).cast("bigint"), lambda a, b: a + b)


def capped(years: Column) -> Column:
    return F.least(years, F.lit(fixed.MAX_YEARS)).cast("int")


def dated_lines(lowered_lines: Column) -> Column:
    """Lines holding a year range as structs ``(line, excluded, works)``. ``lowered_lines`` must be an input column.

    ``excluded`` marks education and project context; ``works`` work context or a company outside of those.
    """

    def judge(line: Column, context: Column) -> Column:
        excluded = sections.is_education(context) | sections.is_project(context)
        return let(excluded, lambda out: F.struct(
            line.alias("line"), out.alias("excluded"),
            (~out & (sections.is_work(context) | found_any(context, fixed.COMPANY_TOKEN))).alias("works")))

    dated = numbered(lowered_lines, lambda line: found(line, fixed.YEAR_RANGE))
    return F.transform(dated, lambda d: let(
        sections.context_window(lowered_lines, d["at"]), lambda context: judge(d["item"], context)))


def range_years_in_context(dated: Column, as_of_year: int) -> Column:
    """Range years of the lines whose context is neither education nor a project, uncapped."""
    kept = F.filter(dated, lambda d: ~d["excluded"])
    return F.aggregate(F.transform(kept, lambda d: range_years(d["line"], as_of_year)),
                       F.lit(0).cast("bigint"), lambda a, b: a + b)


def works_in_context(dated: Column) -> Column:
    """Whether some dated line stands in work context and not in education or project context."""
    return F.exists(dated, lambda d: d["works"])


def experience_years(has_work_section: Column, work_text: Column, text: Column, dated: Column,
                     as_of_year: int) -> Column:
    """Stated years win over summed ranges; a work section, where there is one, is the only place to look."""
    in_section = F.coalesce(stated_years_in_work(work_text), capped(range_years(F.lower(work_text), as_of_year)))
    anywhere = F.coalesce(stated_years_anywhere(text), capped(range_years_in_context(dated, as_of_year)))
    return F.when(has_work_section, in_section).otherwise(anywhere)


def has_experience(has_work_section: Column, work_text: Column, text: Column, dated: Column) -> Column:
    work, whole = F.lower(work_text), F.lower(text)
    in_section = found(work, fixed.WORK_KEYWORD) | found(work, fixed.YEAR_RANGE)
    anywhere = (works_in_context(dated) | found(whole, fixed.FREE_TEXT_YEARS)
                | found(whole, fixed.EMPLOYMENT_PHRASE))
    return F.when(has_work_section, in_section).otherwise(anywhere).cast("int")


# --- education -------------------------------------------------------------------------------------------------------

def degree_score(education_text: Column) -> Column:
    lowered = F.lower(education_text)
    levels = [F.when(found(lowered, text), F.lit(score)).otherwise(F.lit(0.0))
              for _, score, text in fixed.DEGREES]
    return F.greatest(*levels)


def field_words(text: Column) -> Column:
    """Distinct words of three or more letters that could name a field of study."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern(fixed.FIELD_WORD)), 0)
    stop_words = F.array(*[F.lit(w) for w in fixed.FIELD_STOP_WORDS])
    return F.array_except(words, stop_words)


def field_bonus(education_words: Column, job_words: Column) -> Column:
    shared = F.size(F.array_intersect(job_words, education_words))
    return F.when(shared >= 2, F.lit(0.2)).when(shared == 1, F.lit(0.1)).otherwise(F.lit(0.0))


def education_quality(degree: Column, bonus: Column) -> Column:
    return F.least(degree + bonus, F.lit(1.0))


# --- certificates ------------------------------------------------------------------------------------------------------

# Which keyword starts a mention does not matter, so they may be tried in any order.
CERTIFICATE = nested(fixed.CERTIFICATE_KEYWORDS) + fixed.CERTIFICATE_REST


def certificate_mentions(text: Column) -> Column:
    """Keyword mentions anywhere in the text, lower-cased, in order, repetitions kept."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(pattern(CERTIFICATE)), 0)
    return F.filter(F.transform(raw, strip), lambda m: F.length(m) > fixed.MIN_CERTIFICATE_CHARS)


def certificate_lines(certificates_text: Column) -> Column:
    """Distinct lower-cased lines of the certificates section."""
    lines = F.transform(text_lines(F.lower(certificates_text)), strip)
    return F.array_distinct(F.filter(lines, lambda line: F.length(line) > fixed.MIN_CERTIFICATE_CHARS))


def certificates(mentions: Column, lines: Column) -> Column:
    """Mentions, then the section lines not yet mentioned."""
    return F.concat(mentions, F.array_except(lines, mentions))


# --- name ----------------------------------------------------------------------------------------------------------------

def name_from_filename(filename: Column) -> Column:
    stem = F.regexp_replace(filename, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")
    bare = F.regexp_replace(stem, r"(?i)_?(?:resume|cv)|[0-9]+", "")
    spaced = strip(F.regexp_replace(F.translate(bare, "_-", "  "), pattern(r"\s+"), " "))
    runs = F.regexp_extract_all(spaced, F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    title = F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")
    return F.when(title == "", filename).otherwise(title)


def text_length(text: Column) -> Column:
    return F.length(text)


