"""Resume text to features: a map-only stage, one output row per resume row.

Columns are added in steps so that Spark computes each shared piece (lines, headings, segments) once per row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions import extract, projects, sections, skills, vectors
from winnow.functions.common import is_blank, text_lines
from winnow.operators.slices import SLICE, slice_of


def boundary(df: DataFrame) -> DataFrame:
    """Keep filters on computed columns above this point.

    Spark pushes a filter below the projections it reads from by repeating their expressions in it, which for
    staged array work means doing that work again per reference. An explode brings such a filter too (the array is not
    empty), and below a repartitioning it runs in the few tasks that read the table. Observing the rows (a running
    count) stops that; unused columns are still pruned.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def with_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    return df.withColumn("lines", text_lines(F.col(text)))


def explode_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """One row per line with its 0-based position."""
    lined = boundary(df.withColumn("_lines", text_lines(F.col(text))))
    return lined.select(*df.columns, F.posexplode("_lines").alias("pos", "line")).drop(text)


def with_segments(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``lines``, ``headings``, ``segments`` and ``sections_found``."""
    lined = with_lines(df, text).withColumn("headings", sections.headings(F.col("lines")))
    return boundary(lined.select(
        "*",
        sections.segments(F.col("lines"), F.col("headings")).alias("segments"),
        (F.size("headings") > 0).alias("sections_found"),
    ))


def section_texts(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``<name>_text`` per section to rows that have ``segments``."""
    return df.select("*", *[sections.section_text(F.col("segments"), n).alias(f"{n}_text") for n in names])


def with_experience(df: DataFrame, settings: Settings, text: str = "raw_text") -> DataFrame:
    """Adds ``experience_years`` and ``has_experience`` to rows that have ``sections_found`` and ``work_text``."""
    staged = df.withColumn("_work", F.col("sections_found") & ~is_blank(F.col("work_text")))
    # Only the path without a work section looks at lines, so only those rows split theirs.
    staged = staged.withColumn(
        "_lower_lines", F.when(~F.col("_work"), text_lines(F.lower(F.col(text)))).otherwise(F.array().cast(
            "array<string>")))
    staged = staged.withColumn("_dated", extract.dated_lines(F.col("_lower_lines")))
    args = (F.col("_work"), F.col("work_text"), F.col(text), F.col("_dated"))
    return staged.select(
        *df.columns,
        extract.experience_years(*args, settings.as_of_year).alias("experience_years"),
        extract.has_experience(*args).alias("has_experience"),
    )


def with_certificates(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``certificates`` to rows that have ``certificates_text``."""
    staged = df.withColumn("_mentions", extract.certificate_mentions(F.col(text)))
    return staged.select(*df.columns, extract.certificates(
        F.col("_mentions"), extract.certificate_lines(F.col("certificates_text"))).alias("certificates"))


def with_projects(df: DataFrame) -> DataFrame:
    """Adds ``projects`` to rows that have ``lines``, ``sections_found`` and ``projects_text``."""
    staged = df.withColumn("_own", F.col("sections_found") & ~is_blank(F.col("projects_text")))
    # Each row takes one path; the other path sees no lines.
    none = F.array().cast("array<string>")
    staged = staged.select(
        "*",
        F.when(F.col("_own"), text_lines(F.col("projects_text"))).otherwise(none).alias("_section_lines"),
        F.when(F.col("_own"), none).otherwise(F.col("lines")).alias("_free_lines"),
    )
    staged = staged.select(
        "*",
        projects.opening_lines(F.col("_section_lines")).alias("_openings"),
        projects.block_events(F.col("_free_lines")).alias("_events"),
    )
    staged = staged.withColumn("_split", projects.split_projects(F.col("_section_lines"), F.col("_openings")))
    return staged.select(
        *df.columns,
        F.when(F.col("_own"), projects.section_projects(
            F.col("projects_text"), F.col("_section_lines"), F.col("_split")))
        .otherwise(projects.block_projects(F.col("_free_lines"), F.col("_events"))).alias("projects"),
    )


def with_education(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds ``degree_score`` and ``education_words`` to rows that have ``education_text``."""
    staged = df.withColumn("_education", F.when(
        is_blank(F.col("education_text")), F.col(text)).otherwise(F.col("education_text")))
    return staged.select(
        *df.columns,
        extract.degree_score(F.col("_education")).alias("degree_score"),
        extract.field_words(F.col("_education")).alias("education_words"),
    )


def with_skills(df: DataFrame, settings: Settings, text: str = "raw_text") -> DataFrame:
    """Adds ``matched_skills`` and ``skills_count``."""
    matched = boundary(df.withColumn("matched_skills", skills.matched_skills(F.col(text), settings.vocabulary)))
    return matched.withColumn("skills_count", skills.skill_count(F.col("matched_skills")))


def features(resumes: DataFrame, settings: Settings, keep: Sequence[str] = ()) -> DataFrame:
    """Everything a score needs from the resume alone, and the columns ``keep``. The text itself goes no further.

    Columns a plan does not use are pruned with the work behind them. ``resumes`` has ``batch_id, resume_id,
    ordinal, filename, raw_text``; ordinals are unique within a batch. A missing text is an empty one, and rows
    without a batch form one.
    """
    whole = resumes.withColumns({c: F.coalesce(c, F.lit("")) for c in ("batch_id", "raw_text")})
    df = with_segments(whole)
    df = section_texts(df, ["work", "education", "projects", "certificates"]).drop("headings", "segments")
    df = with_experience(df, settings)
    df = with_certificates(df)
    df = with_projects(df)
    df = with_education(df)
    df = with_skills(df, settings)
    return boundary(df.select(
        "batch_id", "resume_id", "ordinal", "filename",
        slice_of(F.col("ordinal"), settings).alias(SLICE),
        extract.name_from_filename(F.col("filename")).alias("name"),
        extract.text_length(F.col("raw_text")).alias("text_length"),
        "matched_skills", "skills_count",
        extract.has_contact(F.col("raw_text")).alias("has_contact"),
        "has_experience", "experience_years", "certificates", "projects", "degree_score", "education_words",
        vectors.term_vector(F.col("raw_text")).alias("term_vector"), *keep,
    ))


def job_facts(jobs: DataFrame, settings: Settings, keep: Sequence[str] = ()) -> DataFrame:
    """Everything a score needs from a job, once per batch. ``jobs`` has ``batch_id, job_description`` and ``keep``."""
    job = F.col("job_description")
    facts = jobs.select(
        "batch_id", "job_description",
        skills.job_skills(job, settings.vocabulary, settings.role_skills).alias("job_skills"),
        extract.field_words(F.coalesce(job, F.lit(""))).alias("job_words"),
        vectors.term_vector(vectors.similarity_job(job, settings.default_job)).alias("job_vector"), *keep,
    )
    return facts.withColumn("job_norm", vectors.norm(F.col("job_vector")))
