"""Text and dense vectors, cosines, and the relevance scores built on them.

The default text vector counts terms within the text alone. It needs no corpus statistics, so a resume scores the
same in any batch and in a stream. A supplied dense embedding column works with the same scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed
from winnow.functions.common import is_blank, let

TERM = r"[a-z0-9]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def term_vector(text: Column) -> Column:
    """MAP of term to count. Counts come from the run lengths of the sorted terms, so the work is linear."""

    def count_runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda s: F.map_from_arrays(
            F.transform(s, lambda i: F.get(ordered, i)),
            F.transform(s, lambda i, j: (F.coalesce(F.get(s, j + 1), F.size(ordered)) - i).cast("double"))))

    return let(F.sort_array(terms(text)), count_runs)


def norm(vector: Column) -> Column:
    """Length of a MAP vector. Counts are whole numbers, so the sum of squares is exact in any order."""
    return F.sqrt(F.aggregate(F.map_values(vector), F.lit(0.0), lambda a, v: a + v * v))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine of two MAP vectors; 0 if either is empty. Give ``norm_b`` where ``b`` meets many vectors."""
    products = F.map_values(F.map_zip_with(a, b, lambda term, x, y: F.coalesce(x * y, F.lit(0.0))))
    dot = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (norm(a) * (norm(b) if norm_b is None else norm_b))
                  ).otherwise(F.lit(0.0))


def text_cosine(text: Column, vector: Column, norm_vector: Column) -> Column:
    """Cosine of a text with a MAP vector, the text's own vector being built once."""
    return let(term_vector(text), lambda v: cosine(v, vector, norm_vector))


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two ARRAY vectors; 0 if either is null or has no length, or if they do not have equally many numbers."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                           F.lit(0.0), lambda acc, v: acc + v)

    return let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), lambda size: F.when(
        size > 0, F.coalesce(dot(a, b) / size, F.lit(0.0))).otherwise(F.lit(0.0)))


def dense_cosines(given: Column, b: Column) -> Column:
    """Cosines of an array of vectors with one vector; no vectors give no cosines, a null vector gives 0."""
    none = F.array().cast("array<double>")
    return F.coalesce(F.transform(given, lambda a: dense_cosine(a, b)), none)


def similarity_job(job: Column, default: str) -> Column:
    """The description to compare with: a blank one is replaced by a default role."""
    return F.when(job.isNull() | is_blank(job), F.lit(default)).otherwise(job)


def skills_match(cos: Column) -> Column:
    return F.least(F.greatest((cos - fixed.MATCH_OFFSET) * fixed.MATCH_GAIN, F.lit(0.0)), F.lit(1.0))


def certificate_relevance(cosines: Column, threshold: float) -> Column:
    """Sum of the cosines above the threshold, at most 1."""
    total = F.aggregate(F.filter(cosines, lambda c: c > threshold), F.lit(0.0), lambda a, c: a + c)
    return F.least(total, F.lit(1.0))


def relevant_projects(cosines: Column, threshold: float = fixed.PROJECT_COSINE) -> Column:
    return F.size(F.filter(cosines, lambda c: c > threshold))


def project_relevance(cosines: Column, threshold: float = fixed.PROJECT_COSINE) -> Column:
    """Mean of the cosines above the threshold plus a boost for their number, at most 1; 0 if there are none."""

    def score(kept: Column) -> Column:
        return boosted_mean(F.aggregate(kept, F.lit(0.0), lambda a, c: a + c), F.size(kept))

    return let(F.filter(cosines, lambda c: c > threshold), score)


def boosted_mean(total: Column, n: Column) -> Column:
    """Mean of ``n`` cosines of sum ``total`` plus a boost for their number, at most 1; 0 if there are none."""
    boost = F.least(n * F.lit(fixed.PROJECT_BOOST), F.lit(fixed.PROJECT_BOOST_CAP))
    return F.when(n > 0, F.least(total / n + boost, F.lit(1.0))).otherwise(F.lit(0.0))
