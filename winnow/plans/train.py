"""Training: sheet and store rows to features, labels and a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.config import Settings
from winnow.functions import extract, vectors
from winnow.operators import features as feats
from winnow.operators import scoring, training
from winnow.operators.slices import materialize, spread
from winnow.sources import sheet as sheets


def training_frame(sheet: DataFrame, stored: DataFrame) -> DataFrame:
    """Both sources as one frame: ``row_id``, text, job, and each source's own columns.

    ``sheet`` has a ``row_id``; ``stored`` is flattened candidates with ``row_id``, ``matched_skills``, ``filename``,
    ``uploaded_at``, ``batch_id`` and ``ordinal``. A file uploaded again counts once, as it was first.
    """
    rows = sheets.synthesize(sheet).withColumnsRenamed({"Skills": "sheet_skills", "Experience_Years": "sheet_years"})
    first = training.first_by_filename(training.store_rows(stored), ["uploaded_at", "batch_id", "ordinal"])
    usable = first.withColumnRenamed("matched_skills", "stored_skills")
    return training.combine(
        rows.select("row_id", "raw_text", "job_description", "sheet_skills", "sheet_years"),
        usable.select("row_id", "raw_text", "job_description", "stored_skills"))


def training_features(frame: DataFrame, settings: Settings) -> DataFrame:
    """Model features and ``quality_score`` per row. Each row is compared with its own job, so nothing is joined."""
    df = feats.with_segments(frame)
    df = feats.section_texts(df, ["work", "education", "projects", "certificates"]).drop("headings", "segments")
    df = feats.with_experience(df, settings).withColumnRenamed("experience_years", "_extracted_years")
    df = feats.with_certificates(df)
    df = feats.with_projects(df)
    df = feats.with_education(df)
    job = F.col("job_description")
    df = df.select(
        "*",
        training.skills_count_by_source(F.col("from_sheet"), F.col("sheet_skills"), F.col("stored_skills"),
                                        F.col("raw_text"), settings).alias("skills_count"),
        training.years_by_source(F.col("from_sheet"), F.col("sheet_years"), F.col("_extracted_years"))
        .alias("experience_years"),
        extract.has_contact(F.col("raw_text")).alias("has_contact"),
        extract.field_words(F.coalesce(job, F.lit(""))).alias("job_words"),
        vectors.term_vector(vectors.similarity_job(job, settings.default_job)).alias("job_vector"),
        vectors.term_vector(F.col("raw_text")).alias("term_vector"),
    )
    df = df.withColumn("job_norm", vectors.norm(F.col("job_vector")))
    compared = scoring.with_similarity(df, settings)
    scored = scoring.with_quality(compared, settings, overlap=False)
    return scored.select(
        "row_id", "from_sheet", "skills_match_score", "skills_count", "has_experience", "certificate_relevance",
        "has_contact", "experience_years", "project_relevance", "education_quality", "quality_score")


def train(features: DataFrame, trees: int = training.TREES):
    """Label, split, fit, evaluate. Pass materialized ``features``.

    Returns the model, the class report on held-out rows and their confusion matrix.
    """
    labelled = training.pseudo_labels(features)
    # The fit takes several passes before it keeps rows of its own: written once, they are not ranked anew in each.
    split = materialize(training.stratified_split(labelled, "shortlisted", "row_id"))
    model = training.fit_forest(split.filter(~F.col("is_test")), trees=trees)
    held_out = training.predict(model, spread(split.filter("is_test")))
    return (model, training.class_report(held_out, "shortlisted", "predicted"),
            training.confusion(held_out, "shortlisted", "predicted"))


def model_signal(model):
    """A ``screen`` model argument: adds ``probability_strong`` to compared features."""
    return lambda df: training.predict(model, df)
