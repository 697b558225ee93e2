"""Matching skill terms in text, and comparing them with a job's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import vocabulary
from winnow.functions.common import empty_texts, is_blank, let, pattern


def matched_skills(text: Column, terms) -> Column:
    """Vocabulary terms found as whole words, in vocabulary order, a repeated term repeated.

    One pass over the text per pattern yields the terms present; only those few are compared with the vocabulary.
    """
    lowered = F.lower(text)
    hits = [F.regexp_extract_all(lowered, F.lit(pattern(p)), 1) for p in vocabulary.patterns(terms)]
    ordered = F.array(*[F.lit(t) for t in terms])
    implied = vocabulary.contained_prefixes(terms)

    def complete(present: Column) -> Column:
        extra = [F.when(F.array_contains(present, longer), F.array(F.lit(shorter))).otherwise(empty_texts())
                 for longer, shorter in implied]
        return F.concat(present, *extra) if extra else present

    def in_order(present: Column) -> Column:
        if len(set(terms)) == len(terms):
            return F.array_intersect(ordered, present)
        return F.filter(ordered, lambda term: F.array_contains(present, term))  # keeps repetitions

    def pick(present: Column) -> Column:
        return F.when(F.size(present) == 0, empty_texts()).otherwise(let(complete(present), in_order))

    return let(F.array_distinct(F.concat(*hits)), pick)


def job_skills(job: Column, terms, role_skills) -> Column:
    """Terms named by a job description, then those its role phrases imply. Blank description: none."""
    named = matched_skills(job, terms)
    lowered = F.lower(job)
    implied = F.concat(*[
        F.when(lowered.contains(phrase), F.array(*[F.lit(s) for s in skills])).otherwise(empty_texts())
        for phrase, skills in role_skills.items()]) if role_skills else empty_texts()
    both = let(named, lambda n: F.concat(n, F.array_except(implied, n)))
    return F.when(job.isNull() | is_blank(job), empty_texts()).otherwise(both)


def skill_count(matched: Column) -> Column:
    """Length of the list, repetitions included; null counts as none."""
    return F.when(matched.isNull(), F.lit(0)).otherwise(F.size(matched))


def overlap(matched: Column, job: Column) -> Column:
    """Share of the job's distinct skills that were matched; 0 for a job without skills."""
    wanted = F.size(F.array_distinct(job))
    return F.when(wanted > 0, F.size(F.array_intersect(matched, job)) / wanted).otherwise(F.lit(0.0))


def matched_for_job(matched: Column, job: Column) -> Column:
    return F.filter(matched, lambda s: F.array_contains(job, s))


def job_first(matched: Column, matched_job: Column) -> Column:
    """Matched skills with the job's first, order otherwise kept; letter case does not matter."""
    return let(F.transform(matched_job, F.lower), lambda wanted: F.concat(
        F.filter(matched, lambda s: F.array_contains(wanted, F.lower(s))),
        F.filter(matched, lambda s: ~F.array_contains(wanted, F.lower(s)))))
