"""Classification rules and candidate scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.geometry import voxel_volume
from scanloom.functions.text import (
    binary_rounded_4,
    blank,
    fixed_decimals,
    has_any_word,
    holds_any_token,
    hash_prefix,
    normalize_text,
    strip,
)
from scanloom.params import SelectionParams

# Whole words looked for in normalised series text.
T1_TOKENS = ("t1", "t1w", "et1w", "mprage", "bravo", "spgr", "tfl3d", "t1seg")
FLAIR_TOKENS = ("flair", "t2flair", "t2 flair", "darkfluid", "dark fluid", "fluid attenuated")
EXCLUDED_TOKENS = (
    "localizer", "scout", "survey", "screensave", "screen save", "mip", "minip", "phoenixzip",
)
T1_FLAIR_TOKENS = ("t1 flair", "t1flair")
MPR_TOKENS = ("mpr", "reformat", "reformatted")
ARTIFACT_TOKENS = ("motion", "repeat", "failed", "artifact", "moco")

# Inversion-recovery timing in milliseconds.
FLAIR_MIN_TR, FLAIR_MIN_TE, FLAIR_MIN_TI = 4000.0, 60.0, 1200.0


def _series_words() -> list[Column]:
    names = ("series_description", "protocol_name", "sequence_name")
    return [*[F.col(c) for c in names], F.array_join("image_type", " ")]


def series_text() -> Column:
    return normalize_text(*_series_words())


def source_kind() -> Column:
    kinds = F.concat(F.lit("\\"), F.upper(F.array_join("image_type", "\\")), F.lit("\\"))

    def named(kind: str) -> Column:
        return F.contains(kinds, F.lit(f"\\{kind}\\"))

    reformatted = has_any_word([F.col("series_description"), F.col("protocol_name")], MPR_TOKENS)
    original = named("ORIGINAL") & named("PRIMARY")
    derived = named("DERIVED") | named("SECONDARY")
    return (
        F.when(reformatted, "derived_mpr")
        .when(original, "original")
        .when(derived, "derived")
        .otherwise("unknown")
    )


def flair_timing() -> Column:
    return F.coalesce(
        (F.col("repetition_time_ms") >= FLAIR_MIN_TR)
        & (F.col("echo_time_ms") >= FLAIR_MIN_TE)
        & (F.col("inversion_time_ms") >= FLAIR_MIN_TI)
        & ~F.isnan("repetition_time_ms")
        & ~F.isnan("echo_time_ms")
        & ~F.isnan("inversion_time_ms"),
        F.lit(False),
    )


def candidate(text: Column) -> Column:
    """``struct(candidate_type, classification_confidence)``; the first matching rule decides."""
    excluded = holds_any_token(text, EXCLUDED_TOKENS)
    flair, t1 = holds_any_token(text, FLAIR_TOKENS), holds_any_token(text, T1_TOKENS)
    t1_flair = holds_any_token(text, T1_FLAIR_TOKENS)

    def verdict(kind: str, confidence: str | Column) -> Column:
        level = F.lit(confidence) if isinstance(confidence, str) else confidence
        return F.struct(
            F.lit(kind).alias("candidate_type"), level.alias("classification_confidence")
        )

    return (
        F.when(
            (F.upper(blank(F.col("modality"))) != "MR") | excluded,
            verdict("other", F.when(excluded, "high").otherwise("low")),
        )
        .when(flair & ~t1_flair, verdict("flair", "high"))
        .when(flair_timing() & ~t1, verdict("flair", "medium"))
        .when(t1 & ~flair, verdict("t1", "high"))
        .otherwise(verdict("other", "low"))
    )


def protocol_id(binary_rounding: bool = False) -> Column:
    """Stable protocol name from twelve acquisition fields; missing numbers leave a slot empty.

    ``binary_rounding`` switches to a pandas UDF that rounds half-way values as other runtimes do.
    """

    def number(c: Column) -> Column:
        text = binary_rounded_4(c) if binary_rounding else fixed_decimals(c, 4)
        return F.when(c.isNull(), "").otherwise(text)

    def word(name: str) -> Column:
        return strip(F.lower(blank(F.col(name))))

    spacing = [number(F.get("pixel_spacing_mm", F.lit(i))) for i in (0, 1)]
    fields = [
        F.col("candidate_type"),
        word("manufacturer"),
        word("model_name"),
        word("software_versions"),
        strip(F.upper(blank(F.col("acquisition_type")))),
        number(F.col("repetition_time_ms")),
        number(F.col("echo_time_ms")),
        number(F.col("inversion_time_ms")),
        number(F.col("flip_angle_deg")),
        number(F.col("slice_thickness_mm")),
        number(F.col("spacing_between_slices_mm")),
        F.when(F.size("pixel_spacing_mm") == 2, F.concat_ws("x", *spacing)).otherwise(""),
    ]
    return F.concat_ws("-", "candidate_type", hash_prefix(F.concat_ws("|", *fields), 10))


def _penalty(condition: Column, points: float) -> Column:
    return F.when(condition, -points).otherwise(0.0)


# The weights and caps of the scores below; terms are added in the order given.


def _volume_reward(weight: float, cap: float) -> Column:
    volume = voxel_volume(F.col("pixel_spacing_mm"), F.col("slice_thickness_mm"))
    reward = F.least(F.lit(cap), F.lit(weight) / F.greatest(volume, F.lit(0.1)))
    return F.when(volume.isNotNull(), reward).otherwise(0.0)


def _is_type(name: str) -> Column:
    return F.upper(blank(F.col("acquisition_type"))) == name


def score_t1(params: SelectionParams) -> Column:
    kind, coverage = F.col("source_kind"), F.col("coverage_mm")
    return (
        F.when(kind == "original", 100.0)
        .when(kind == "derived_mpr", 65.0)
        .when(kind == "unknown", 25.0)
        .otherwise(5.0)
        + F.when(_is_type("3D"), 15.0).otherwise(0.0)
        + F.when(coverage.isNotNull(), F.least(F.lit(30.0), coverage / 5.0)).otherwise(0.0)
        + _penalty(coverage < params.minimum_brain_coverage_mm, 30.0)
        + _volume_reward(20.0, 25.0)
        + _penalty(~F.col("orientation_consistent"), 100.0)
    )


def slice_gap() -> Column:
    return F.col("spacing_between_slices_mm") - F.col("slice_thickness_mm")


def score_flair(params: SelectionParams) -> Column:
    kind, coverage = F.col("source_kind"), F.col("coverage_mm")
    thickness, gap = F.col("slice_thickness_mm"), slice_gap()
    # NaN sorts above every number in Spark, so it has to be ruled out by name.
    wide_enough = (coverage >= params.minimum_brain_coverage_mm) & ~F.isnan(coverage)
    flat = F.when(_is_type("2D") & (F.col("plane") == "axial"), 15.0).otherwise(0.0)
    return (
        F.when(kind == "original", 60.0)
        .when(kind == "unknown", 25.0)
        .when(kind == "derived", 5.0)
        .otherwise(10.0)
        + (F.when(_is_type("3D"), 35.0).otherwise(flat) if params.flair_prefer_3d else flat)
        + F.when(coverage.isNull(), 0.0).when(wide_enough, 30.0).otherwise(-40.0)
        + _volume_reward(28.0, 35.0)
        + F.when(thickness.isNull(), 0.0)
        .when(thickness <= 1.5, 20.0)
        .when(thickness <= 3.0, 12.0)
        .when(thickness <= 5.0, 4.0)
        .otherwise(-15.0)
        + F.when(gap.isNull(), 0.0)
        .when(gap <= 0.5, 8.0)
        .otherwise(-F.least(F.lit(20.0), gap * 4.0))
        + _penalty(F.col("classification_confidence") == "medium", 5.0)
        + _penalty(has_any_word(_series_words(), ARTIFACT_TOKENS), 40.0)
        + _penalty(~F.col("orientation_consistent"), 100.0)
    )


def score(params: SelectionParams) -> Column:
    kind = F.col("candidate_type")
    return (
        F.when(kind == "t1", score_t1(params))
        .when(kind == "flair", score_flair(params))
        .otherwise(0.0)
    )


def output_basename(
    subject: Column, candidate_type: Column, kind: Column, status: Column
) -> Column:
    """Target name of a selected series, empty for every other status."""
    stem = F.concat(F.lit("sub-"), subject)
    rec = F.when(kind == "derived_mpr", "_rec-axialmpr").otherwise("")
    return (
        F.when(status != "selected", "")
        .when(candidate_type == "t1", F.concat(stem, rec, F.lit("_T1w")))
        .when(candidate_type == "flair", F.concat(stem, F.lit("_FLAIR")))
        .otherwise("")
    )


def manual_basename(subject: Column, candidate_type: Column, decision: Column) -> Column:
    stem = F.concat(F.lit("sub-"), subject)
    entity = (
        F.when(decision == "accept_mpr", "_rec-axialmpr")
        .when(decision == "accept_sag_fallback", "_acq-manualsag")
        .otherwise("")
    )
    return F.when(candidate_type == "flair", F.concat(stem, F.lit("_FLAIR"))).otherwise(
        F.concat(stem, entity, F.lit("_T1w"))
    )


def suffix_of(candidate_type: Column) -> Column:
    return F.when(candidate_type == "t1", "T1w").otherwise("FLAIR")
