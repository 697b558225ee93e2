"""Settings of a screening or training run."""

from __future__ import annotations

from dataclasses import dataclass, field

from winnow import fixed


@dataclass(frozen=True)
class Settings:
    """Every value a run may change. ``as_of_year`` closes open date ranges and has no clock default."""

    as_of_year: int
    vocabulary: tuple[str, ...] = tuple(fixed.SKILLS)
    role_skills: dict[str, list[str]] = field(default_factory=lambda: dict(fixed.ROLE_SKILLS))
    weights: dict[str, float] = field(default_factory=lambda: dict(fixed.WEIGHTS))
    default_job: str = fixed.DEFAULT_JOB
    certificate_cosine: float = fixed.CERTIFICATE_COSINE_SCORING
    project_cosine: float = fixed.PROJECT_COSINE
    experience_floor: float = fixed.EXPERIENCE_FLOOR
    # Rows of one batch that share a slice. Bounds every group that a task must hold, see winnow.plans.slices.
    slice_rows: int = 1_000_000
    # Largest side that may be broadcast, in rows and in characters of text. Beyond it the sliced join is used.
    broadcast_rows: int = 100_000
    broadcast_chars: int = 8_000_000


def scoring(as_of_year: int, **changes) -> Settings:
    """Settings of the scoring preset."""
    return Settings(as_of_year=as_of_year, **changes)


def training(as_of_year: int, **changes) -> Settings:
    """Settings of the training preset: stricter certificates, no experience floor, its own default job."""
    preset = {
        "default_job": fixed.DEFAULT_TRAINING_JOB,
        "certificate_cosine": fixed.CERTIFICATE_COSINE_TRAINING,
        "experience_floor": 0.0,
    }
    return Settings(as_of_year=as_of_year, **{**preset, **changes})
