"""Vectors that an embedding model made of the texts: which texts to embed, and binding the vectors to the rows.

``texts_to_embed`` lists the texts, any model embeds them, ``bind_vectors`` and ``bind_job_vectors`` bring the vectors
back as columns, and ``screen(..., vectors=TextVectors())`` compares these instead of term counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions.vectors import similarity_job
from winnow.operators.features import features

TEXT, CERTIFICATE, PROJECT = "text", "certificate", "project"


@dataclass(frozen=True)
class TextVectors:
    """Names of the columns with vectors: of a resume's text (ARRAY of numbers), of its certificates and its projects
    (ARRAY of such), and of a batch's job. A missing vector has no similarity; vectors of unequal length neither."""

    text: str = "text_vector"
    certificates: str = "certificate_vectors"
    projects: str = "project_vectors"
    job: str = "job_embedding"

    @property
    def of_resume(self) -> list[str]:
        return [self.text, self.certificates, self.projects]


def texts_to_embed(resumes: DataFrame, settings: Settings) -> DataFrame:
    """``resume_id, kind, n, text``: every text that a score compares with the job, numbered within its kind."""
    rows = features(resumes.withColumn("_text", F.coalesce("raw_text", F.lit(""))), settings, keep=["_text"])

    def numbered(kind: str, texts):
        return F.transform(texts, lambda t, n: F.struct(F.lit(kind).alias("kind"), n.alias("n"), t.alias("text")))

    every = F.concat(numbered(TEXT, F.array("_text")), numbered(CERTIFICATE, F.col("certificates")),
                     numbered(PROJECT, F.col("projects")))
    return rows.select("resume_id", F.explode(every).alias("t")).select("resume_id", "t.*")


def job_texts_to_embed(jobs: DataFrame, settings: Settings) -> DataFrame:
    """``batch_id, text``: what each batch's job is compared as."""
    return jobs.select("batch_id", similarity_job(F.col("job_description"), settings.default_job).alias("text"))


def bind_vectors(resumes: DataFrame, embedded: DataFrame, given: TextVectors = TextVectors()) -> DataFrame:
    """``resumes`` with the vectors of ``embedded`` (``resume_id, kind, n, vector``) as columns.

    A resume has few texts, so its group is small whatever its batch; the vectors are shuffled once, by resume.
    """
    def of(kind: str):
        entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "vector"))))
        return F.transform(entries, lambda e: e["vector"])

    bound = embedded.groupBy("resume_id").agg(
        F.get(of(TEXT), F.lit(0)).alias(given.text), of(CERTIFICATE).alias(given.certificates),
        of(PROJECT).alias(given.projects))
    return resumes.join(bound, "resume_id", "left")


def bind_job_vectors(jobs: DataFrame, embedded: DataFrame, given: TextVectors = TextVectors()) -> DataFrame:
    """``jobs`` with the vectors of ``embedded`` (``batch_id, vector``)."""
    return jobs.join(embedded.select("batch_id", F.col("vector").alias(given.job)), "batch_id", "left")
