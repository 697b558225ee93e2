"""Screening: resumes and jobs in, scored, ranked and flagged candidates out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions import scores
from winnow.operators import scoring
from winnow.operators.corpus import HashedCorpus
from winnow.operators.embedded import TextVectors
from winnow.operators.features import boundary, features
from winnow.operators.slices import materialize


def compared(resumes: DataFrame, jobs: DataFrame, settings: Settings, vectors: TextVectors | None = None,
             corpus: HashedCorpus | None = None) -> DataFrame:
    """Features of every resume compared with its batch's job: by term counts, by the given ``vectors``, or by term
    counts weighted by a ``corpus``."""
    if vectors is None:
        df = scoring.with_job(features(resumes, settings, keep=["raw_text"] if corpus else []), jobs, settings)
        cosines = corpus.cosines(settings) if corpus else scoring.term_cosines
    else:
        df = scoring.with_job(features(resumes, settings, keep=vectors.of_resume), jobs, settings, keep=[vectors.job])
        cosines = scoring.supplied_cosines(vectors)
    return boundary(scoring.with_similarity(scoring.with_overlap(df), settings, cosines))


def keyword_scores(resumes: DataFrame, jobs: DataFrame, settings: Settings) -> DataFrame:
    """Score by vocabulary overlap alone, the path without a model; it finds no certificates and no projects."""
    df = compared(resumes, jobs, settings).withColumns({
        "certificate_relevance": F.lit(0.0),
        "project_relevance": F.lit(0.0),
        "relevant_projects_count": F.lit(0),
        "score": scores.keyword_score(
            F.col("jd_overlap"), F.col("job_skills"), F.col("skills_count"), len(settings.vocabulary)),
    })
    return scoring.project_scored(df)


def blended_scores(resumes: DataFrame, jobs: DataFrame, settings: Settings, model=None,
                   vectors: TextVectors | None = None, corpus: HashedCorpus | None = None) -> DataFrame:
    """The full score. ``model`` maps features to ``probability_strong``; without one the signal is neutral."""
    df = scoring.with_quality(compared(resumes, jobs, settings, vectors, corpus), settings)
    signal = None
    if model is not None:
        df, signal = model(df), F.col("probability_strong")
    return scoring.project_scored(df.withColumn("score", scores.blend(F.col("quality_score"), signal)))


def screen(resumes: DataFrame, jobs: DataFrame, settings: Settings, model=None,
           keywords_only: bool = False, vectors: TextVectors | None = None,
           corpus: HashedCorpus | None = None) -> DataFrame:
    """Score, rank and flag all batches.

    Texts are compared with the job by their term counts. ``vectors`` names columns of ``resumes`` and ``jobs`` that hold
    vectors of an embedding model to compare instead (see ``operators.embedded``); ``corpus`` weights terms by their
    rarity (see ``operators.corpus.hashed_corpus``).

    Text is read once and never shuffled; the narrow scored rows are written to the shared folder because ranks
    and limits need them twice.
    """
    scored = (keyword_scores(resumes, jobs, settings) if keywords_only
              else blended_scores(resumes, jobs, settings, model, vectors, corpus))
    return scoring.rank_and_flag(materialize(scored), settings)
