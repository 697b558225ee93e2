"""Comparing features with jobs, scoring, ranking and flagging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow import fixed
from winnow.config import Settings
from winnow.functions import extract, scores, skills, vectors
from winnow.functions.common import exact_round
from winnow.operators.features import job_facts
from winnow.operators.embedded import TextVectors
from winnow.operators.slices import SLICE, Part, join_batch_facts, ordered_rank, slice_of


def with_job(features: DataFrame, jobs: DataFrame, settings: Settings, keep: Sequence[str] = ()) -> DataFrame:
    """Attach the batch's job facts and its columns ``keep``; a batch without a job behaves like one with a blank
    description."""
    facts = job_facts(jobs, settings, keep)
    joined = join_batch_facts(features, facts, settings, text="job_description")
    none = F.array().cast("array<string>")
    default = vectors.term_vector(F.lit(settings.default_job))
    return joined.withColumns({
        "job_description": F.coalesce("job_description", F.lit("")),
        "job_skills": F.coalesce("job_skills", none),
        "job_words": F.coalesce("job_words", none),
        "job_vector": F.coalesce("job_vector", default),
        "job_norm": F.coalesce("job_norm", vectors.norm(default)),
    })


def with_overlap(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        skills.overlap(F.col("matched_skills"), F.col("job_skills")).alias("jd_overlap"),
        skills.matched_for_job(F.col("matched_skills"), F.col("job_skills")).alias("jd_matched_skills"),
    )


def term_cosines(df: DataFrame) -> DataFrame:
    """Adds ``_cosine``, ``_certificates`` and ``_projects``: similarity with the job by term counts."""

    def against_job(texts: str):
        return F.transform(F.col(texts), lambda t: vectors.text_cosine(t, F.col("job_vector"), F.col("job_norm")))

    return df.select(
        "*",
        vectors.cosine(F.col("term_vector"), F.col("job_vector"), F.col("job_norm")).alias("_cosine"),
        against_job("certificates").alias("_certificates"),
        against_job("projects").alias("_projects"),
    )


def supplied_cosines(given: TextVectors) -> Callable[[DataFrame], DataFrame]:
    """What ``term_cosines`` adds, from vectors that come with the rows. The texts are not looked at."""
    job = F.col(given.job)
    return lambda df: df.select(
        "*",
        vectors.dense_cosine(F.col(given.text), job).alias("_cosine"),
        vectors.dense_cosines(F.col(given.certificates), job).alias("_certificates"),
        vectors.dense_cosines(F.col(given.projects), job).alias("_projects"),
    )


def with_similarity(df: DataFrame, settings: Settings,
                    cosines: Callable[[DataFrame], DataFrame] = term_cosines) -> DataFrame:
    """Adds the relevance scores and education quality to features joined with their job."""
    staged = cosines(df)
    bonus = extract.field_bonus(F.col("education_words"), F.col("job_words"))
    return staged.select(
        *(c for c in df.columns if c in staged.columns),
        vectors.skills_match(F.col("_cosine")).alias("skills_match_score"),
        vectors.certificate_relevance(F.col("_certificates"), settings.certificate_cosine)
        .alias("certificate_relevance"),
        vectors.project_relevance(F.col("_projects"), settings.project_cosine).alias("project_relevance"),
        vectors.relevant_projects(F.col("_projects"), settings.project_cosine).alias("relevant_projects_count"),
        extract.education_quality(F.col("degree_score"), bonus).alias("education_quality"),
    )


def with_quality(df: DataFrame, settings: Settings, overlap: bool = True) -> DataFrame:
    """Adds ``quality_score``; ``overlap`` False gives the training formula."""
    c = F.col
    experience = scores.experience_norm(
        c("experience_years"), c("skills_count"), c("project_relevance"), settings.experience_floor)
    return df.withColumn("quality_score", scores.quality(
        settings.weights, c("skills_match_score"), experience, c("certificate_relevance"), c("has_contact"),
        c("skills_count"), c("project_relevance"), c("education_quality"), c("jd_overlap") if overlap else None))


def project_scored(df: DataFrame) -> DataFrame:
    """The reported columns."""
    return df.select(
        "batch_id", "resume_id", "ordinal", "name", "score", "matched_skills", "jd_matched_skills",
        "experience_years",
        (F.col("certificate_relevance") > 0).alias("has_relevant_cert"),
        exact_round(F.col("project_relevance"), 3).alias("project_relevance_score"),
        "relevant_projects_count",
        exact_round(F.col("education_quality"), 2).alias("education_quality"),
        "filename", "text_length",
    )


def project_scores(projects: DataFrame, *keys: str, threshold: float = fixed.PROJECT_COSINE) -> DataFrame:
    """Per ``keys``: ``project_relevance`` and ``relevant_projects_count`` of projects that are rows with a ``cosine``.

    For vectors that come with the data, one row per project; sums combine on the map side.
    """
    kept = F.when(F.col("cosine") > threshold, F.col("cosine"))
    sums = projects.groupBy(*keys).agg(F.sum(kept).alias("_total"), F.count(kept).alias("relevant_projects_count"))
    score = vectors.boosted_mean(F.col("_total"), F.col("relevant_projects_count"))
    return sums.select(*keys, score.alias("project_relevance"), "relevant_projects_count")


def rank(scored: DataFrame, settings: Settings) -> DataFrame:
    """Rank 1..n per batch by score, ties in input order. ``scored`` is read twice, pass it materialized.

    Scores have one decimal, so a batch splits into at most 1,001 scores times its slices.
    """
    return ordered_rank(
        scored, ["batch_id"],
        [Part(F.col("score"), descending=True), Part(slice_of(F.col("ordinal"), settings))],
        [F.col("ordinal")])


def _length_limits(totals: DataFrame) -> DataFrame:
    """Mean plus two sample deviations from exact sums ``n, s1, s2`` of whole-number lengths."""
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    wide = "decimal(38,0)"
    spread = (n.cast(wide) * s2 - s1.cast(wide) * s1.cast(wide)).cast("double")
    deviation = F.when(n > 1, F.sqrt(spread / (n * (n - 1)))).otherwise(F.lit(0.0))
    staged = totals.select("*", (s1 / n).alias("mean_length"), deviation.alias("length_deviation"))
    return staged.withColumn("length_limit", F.col("mean_length") + 2 * F.col("length_deviation"))


def _length_sums(length: str = "text_length"):
    size = F.col(length).cast("bigint")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(size).alias("s1"),
        F.sum((size * size).cast("decimal(20,0)")).cast("decimal(38,0)").alias("s2"),
    ]


def length_limits(rows: DataFrame) -> DataFrame:
    """Per batch: ``n``, mean, deviation and the limit above which a text is abnormally long.

    Sums combine on the map side, so a hot batch costs no more than its partial rows.
    """
    return _length_limits(rows.groupBy("batch_id").agg(*_length_sums())).drop("s1", "s2")


def with_flag(df: DataFrame) -> DataFrame:
    """Adds the outlier flag and its reason from ``text_length`` and the batch's limit."""
    flagged = F.coalesce(
        (F.col("length_deviation") > 0) & (F.col("text_length") > F.col("length_limit")), F.lit(False))
    return df.withColumn("is_anomaly", flagged).withColumn(
        "anomaly_reason", F.when(F.col("is_anomaly"), F.lit(fixed.ANOMALY_REASON)).otherwise(F.lit("")))


def flag_outliers(rows: DataFrame, settings: Settings) -> DataFrame:
    """Flag texts longer than the batch's limit. ``rows`` has ``batch_id, ordinal, text_length``."""
    keyed = rows.withColumn(SLICE, slice_of(F.col("ordinal"), settings))
    joined = join_batch_facts(keyed, length_limits(rows), settings)
    return with_flag(joined).drop(SLICE, "n", "mean_length", "length_deviation", "length_limit")


def score_parts(scored: DataFrame, settings: Settings) -> DataFrame:
    """Number of rows and sums of lengths per batch, score and slice: all that ranks and limits need to know of other
    rows. Scores have one decimal, so a batch has at most 1,001 of them times its slices."""
    rows = scored.withColumn(SLICE, slice_of(F.col("ordinal"), settings))
    return rows.groupBy("batch_id", "score", SLICE).agg(*_length_sums())


def merged_parts(parts: DataFrame, *keys: str) -> DataFrame:
    """``score_parts`` of several tables added up per ``keys``."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").cast("decimal(38,0)").alias("s2"))


def limits_of_parts(parts: DataFrame) -> DataFrame:
    """``length_limits`` from ``score_parts``, without the rows."""
    return _length_limits(merged_parts(parts, "batch_id")).drop("s1", "s2")


def rank_and_flag(scored: DataFrame, settings: Settings, parts: DataFrame | None = None,
                  first: int | None = None) -> DataFrame:
    """``rank`` and ``flag_outliers`` in one pass: the part sizes that give ranks also carry the length sums.

    ``parts`` are the ``score_parts`` of all rows where they are kept; ``scored`` is then read once. ``first`` keeps that
    many candidates of every batch; only rows of parts that reach so far are sorted.
    """
    keys = ["batch_id", "score", SLICE]
    rows = scored.withColumn(SLICE, slice_of(F.col("ordinal"), settings))
    parts = score_parts(scored, settings) if parts is None else merged_parts(parts, *keys)
    batch = Window.partitionBy("batch_id")
    before = batch.orderBy(F.col("score").desc(), SLICE).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.select(
        *keys,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
        F.sum("n").over(batch).alias("n"),
        F.sum("s1").over(batch).alias("s1"),
        F.sum("s2").over(batch).cast("decimal(38,0)").alias("s2"),
    )
    limits = _length_limits(totals).drop("n", "s1", "s2", "mean_length")
    if first is not None:
        limits = limits.filter(F.col("_before") < first)
    within = Window.partitionBy(*keys).orderBy("ordinal")
    ranked = with_flag(rows.join(limits, keys)).withColumn("rank", F.col("_before") + F.row_number().over(within))
    if first is not None:
        ranked = ranked.filter(F.col("rank") <= first)
    return ranked.select(*scored.columns, "rank", "is_anomaly", "anomaly_reason")
