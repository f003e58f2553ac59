"""Semantic settings, validated on construction."""

from __future__ import annotations

from dataclasses import dataclass


# The names and defaults of the parameters.


@dataclass(frozen=True)
class SelectionParams:
    axial_max_angle_deg: float = 20.0
    orientation_consistency_deg: float = 3.0
    manual_review_margin: float = 5.0
    allow_axial_mpr_fallback: bool = True
    minimum_brain_coverage_mm: float = 100.0
    flair_prefer_3d: bool = True

    def __post_init__(self) -> None:
        if not 0.0 < self.axial_max_angle_deg < 45.0:
            raise ValueError("axial_max_angle_deg must lie between 0 and 45, both excluded")
        if not 0.0 < self.orientation_consistency_deg < 30.0:
            raise ValueError("orientation_consistency_deg must lie between 0 and 30, both excluded")


@dataclass(frozen=True)
class WorkParams:
    convert_review_candidates: bool = True
    resume: bool = True
    retry_failed: bool = False


@dataclass(frozen=True)
class PilotParams:
    per_stratum: int = 2

    def __post_init__(self) -> None:
        if self.per_stratum < 1:
            raise ValueError("per_stratum must be at least 1")


@dataclass(frozen=True)
class ResourceMinimums:
    """Free-space and memory floors in GiB; zero switches a floor off."""

    work_free_gb: float = 0.0
    staging_free_gb: float = 0.0
    memory_available_gb: float = 0.0

    def __post_init__(self) -> None:
        if min(self.work_free_gb, self.staging_free_gb, self.memory_available_gb) < 0:
            raise ValueError("resource minimums must not be negative")


# What a release is checked against unless the caller gives more, which reports must match. Site words and
# private paths are the caller's.
PROHIBITED_SUFFIXES = (
    ".nii.gz", ".dcm", ".ima", ".nii", ".bval", ".bvec", ".p12", ".pfx", ".pem", ".key",
)
SECRET_MARKERS = ("ghp_", "github_pat_", "BEGIN PRIVATE KEY")
MAX_FILE_BYTES = 5 * 1024 * 1024
EXCLUDED_DIRECTORIES = (
    ".git", ".venv", "build", "dist", "htmlcov", "__pycache__", ".pytest_cache", ".ruff_cache",
)
EXCLUDED_FILES = (".coverage",)


@dataclass(frozen=True)
class ReleasePolicy:
    forbidden_tokens: tuple[str, ...] = ()
    prohibited_suffixes: tuple[str, ...] = PROHIBITED_SUFFIXES
    private_paths: tuple[str, ...] = ()
    secret_markers: tuple[str, ...] = SECRET_MARKERS
    max_bytes: int = MAX_FILE_BYTES
    excluded_directories: tuple[str, ...] = EXCLUDED_DIRECTORIES
    excluded_files: tuple[str, ...] = EXCLUDED_FILES
