"""Keyed merges into dataset tables whose extra columns are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scoring import suffix_of
from scanloom.functions.text import blank, site_id
from scanloom.operators.review import last_per_key

MISSING = "n/a"
SCAN_FIELDS = ["protocol_id", "source_plane", "source_kind", "selection_qc"]


def several_centers(series: DataFrame) -> DataFrame:
    """Subjects whose series come from more than one center."""
    ends = series.groupBy("subject_id").agg(F.min("center").alias("first"), F.max("center").alias("last"))
    return ends.filter(F.col("first") != F.col("last"))


def participants_upsert(
    existing: DataFrame | None, series: DataFrame, position: str | None = None, on_problem: str = "raise"
) -> DataFrame:
    """Existing rows stay, new subjects are added, the site is set for every subject at hand.

    Of rows with one participant_id the last by ``position`` counts; without it the ids must be unique.
    A subject of two centers stops the run, or is left out with ``on_problem="report"``
    (``several_centers`` lists them).
    """
    if on_problem == "raise":
        found = several_centers(series).orderBy("subject_id").limit(20).collect()
        if found:
            raise ValueError("subjects in several centers: " + ", ".join(f"sub-{r['subject_id']}" for r in found))
    elif on_problem != "report":
        raise ValueError(on_problem)
    centers = series.groupBy("subject_id").agg(F.min("center").alias("center"), F.max("center").alias("_last"))
    sites = centers.filter(F.col("center") == F.col("_last")).select(
        F.concat(F.lit("sub-"), "subject_id").alias("participant_id"),
        site_id(F.col("center")).alias("_site"),
    )
    if existing is None:
        return sites.withColumnRenamed("_site", "site_id")
    kept = existing.filter(blank(F.col("participant_id")) != "")
    if position:
        kept = last_per_key(kept, ["participant_id"], [position]).drop(position)
    fields = [c for c in kept.columns if c != "participant_id"]
    if "site_id" not in fields:
        fields.append("site_id")
        kept = kept.withColumn("site_id", F.lit(None).cast("string"))
    merged = kept.join(sites, "participant_id", "full_outer")

    def value(c: str):
        own = F.coalesce("_site", "site_id") if c == "site_id" else F.col(c)
        return F.coalesce(F.nullif(own, F.lit("")), F.lit(MISSING)).alias(c)

    return merged.select("participant_id", *[value(c) for c in fields])


def scans_upsert(existing: DataFrame, incoming: DataFrame, position: str | None = None) -> DataFrame:
    """Replace the scan of a subject and modality; other rows and extra columns stay.

    ``existing``: subject_id, filename and any columns. ``incoming``: subject_id, candidate_type,
    filename and the four facts of a scan. Of existing rows with one file name the last by
    ``position`` counts; without it they must be unique. Columns keep their order, new ones follow.
    """
    if position:
        existing = last_per_key(existing, ["subject_id", "filename"], [position]).select(
            *[c for c in existing.columns if c != position]
        )
    fresh = incoming.select(
        "subject_id", "filename", suffix_of(F.col("candidate_type")).alias("_suffix"),
        *[F.col(c).alias(f"_{c}") for c in SCAN_FIELDS],
    )
    stem = r"^anat/.*(T1w|FLAIR)\.nii(\.gz)?$"
    prior = existing.filter(blank(F.col("filename")) != "").withColumn(
        "_suffix", F.nullif(F.regexp_extract("filename", stem, 1), F.lit(""))
    )
    replaced = fresh.select("subject_id", "_suffix", F.col("filename").alias("_new"))
    # A file name of one modality ends in one suffix only, so one incoming row at most retires it.
    kept = (
        prior.join(replaced, ["subject_id", "_suffix"], "left")
        .filter(F.col("_new").isNull() | (F.col("_new") == F.col("filename")))
        .drop("_new", "_suffix")
    )
    merged = kept.join(fresh.drop("_suffix"), ["subject_id", "filename"], "full_outer")
    own = [c for c in existing.columns if c not in ("subject_id", "filename")]
    fields = [*own, *[c for c in SCAN_FIELDS if c not in own]]

    def value(c: str):
        old = F.col(c) if c in existing.columns else F.lit(None).cast("string")
        own = F.coalesce(F.col(f"_{c}"), old) if c in SCAN_FIELDS else old
        return F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.lit(MISSING)).alias(c)

    return merged.select("subject_id", "filename", *[value(c) for c in fields])
