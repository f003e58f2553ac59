"""Protocol catalogue and inventory summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.functions.text import join_values
from scanloom.operators.inventory import inventory_counts, series_order
from scanloom.schemas import CATALOG, columns

_FROM_FIRST = [
    "candidate_type", "manufacturer", "model_name", "software_versions", "acquisition_type",
    "repetition_time_ms", "echo_time_ms", "inversion_time_ms", "slice_thickness_mm",
    "pixel_spacing_mm",
]


def protocol_catalog(series: DataFrame) -> DataFrame:
    """One row per protocol: attributes of its first series, counts and centers.

    Counting goes through one row per (protocol, subject), so that a protocol with a large share
    of all series is spread over many tasks.
    """
    per_subject = series.groupBy("protocol_id", "subject_id").agg(
        F.min(
            F.struct(F.struct(*series_order()).alias("place"), F.struct(*_FROM_FIRST).alias("row"))
        ).alias("first"),
        F.count(F.lit(1)).alias("n_series"),
    )
    grouped = per_subject.groupBy("protocol_id").agg(
        F.min("first").alias("first"),
        F.sum("n_series").alias("series_count"),
        F.count(F.lit(1)).alias("subject_count"),
    )
    centers = (
        series.select("protocol_id", "center")
        .distinct()
        .groupBy("protocol_id")
        .agg(F.array_join(F.array_sort(F.collect_list("center")), ";").alias("centers"))
    )
    return (
        grouped.join(centers, "protocol_id")
        .select("protocol_id", "first.row.*", "series_count", "subject_count", "centers")
        .withColumn("pixel_spacing_mm", join_values(F.col("pixel_spacing_mm").cast("array<string>")))
        .select(*columns(CATALOG))
    )


def inventory_summary(instances: DataFrame, series: DataFrame, selection: DataFrame) -> DataFrame:
    """One row: series, subjects, files seen, unreadable files, selected and review rows."""
    parts = [
        series.agg(
            F.count(F.lit(1)).alias("series"), F.countDistinct("subject_id").alias("subjects")
        ),
        inventory_counts(instances),
        selection.agg(
            F.count_if(F.col("decision_status") == "selected").alias("selected"),
            F.count_if(F.col("decision_status") == "review").alias("review"),
        ),
    ]
    # Each side is a single aggregate row.
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return keyed[0].join(keyed[1], "_one").join(keyed[2], "_one").drop("_one")


def counts_by(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    """Rows per value; a missing value counts as ``unknown``."""
    value = F.coalesce(F.col(column), F.lit(missing)).alias(column)
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
