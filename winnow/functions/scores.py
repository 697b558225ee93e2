"""The quality formula, its blend with a model, and display bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from winnow import fixed
from winnow.functions.common import exact_round

NEUTRAL_SIGNAL = 0.5
QUALITY_SHARE, SIGNAL_SHARE = 0.80, 0.20
FULL_SKILLS = 15.0
FLOOR_SKILLS, FLOOR_PROJECT = 5, 0.3


def experience_norm(years: Column, skills: Column, project: Column, floor: float) -> Column:
    """Years against the cap; without years, a small floor for candidates strong in skills or projects."""
    share = F.least(years / F.lit(fixed.EXPERIENCE_NORM_CAP), F.lit(1.0))
    if not floor:
        return share
    strong = (skills >= FLOOR_SKILLS) | (project > FLOOR_PROJECT)
    return F.when((years == 0) & strong, F.lit(floor)).otherwise(share)


def quality(weights, skills_match: Column, experience: Column, certificate: Column, contact: Column,
            skills: Column, project: Column, education: Column, overlap: Column | None = None) -> Column:
    """Weighted sum of the features. Without ``overlap`` it is the training formula."""
    total = skills_match * F.lit(weights["skills_match"])
    if overlap is not None:
        total = overlap * F.lit(weights["jd_skill_overlap"]) + total
    return (
        total
        + experience * F.lit(weights["experience"])
        + certificate * F.lit(weights["certificates"])
        + contact * F.lit(weights["contact_info"])
        + F.least(skills / F.lit(FULL_SKILLS), F.lit(1.0)) * F.lit(weights["skills_count"])
        + project * F.lit(weights["project_relevance"])
        + education * F.lit(weights["education_quality"])
    )


def blend(quality_score: Column, signal: Column | None = None) -> Column:
    """Percent score to one decimal; a missing model probability counts as neutral."""
    strong = F.coalesce(signal, F.lit(NEUTRAL_SIGNAL)) if signal is not None else F.lit(NEUTRAL_SIGNAL)
    return exact_round((quality_score * QUALITY_SHARE + strong * SIGNAL_SHARE) * 100, 1)


def keyword_score(overlap: Column, job_skills: Column, skills: Column, vocabulary_size: int) -> Column:
    """Score without a model: job overlap, or the share of the vocabulary if the job names no skill."""
    share = skills / F.lit(vocabulary_size) if vocabulary_size else F.lit(0.0)
    return exact_round(F.when(F.size(job_skills) > 0, overlap).otherwise(share) * 100, 1)


def band(score: Column) -> Column:
    return (
        F.when(score >= fixed.HIGH_BAND, F.lit("high"))
        .when(score >= fixed.MEDIUM_BAND, F.lit("medium"))
        .otherwise(F.lit("low"))
    )
