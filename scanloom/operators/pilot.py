"""Drawing a stratified pilot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.inventory import series_order
from scanloom.operators.review import series_lookup
from scanloom.operators.staging import stage
from scanloom.params import PilotParams
from scanloom.schemas import PILOT, SERIES_KEYS, columns

STRATUM = ["center", "manufacturer", "model_name", "protocol_id"]


def _first_subjects(members: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Count the members of every group and keep the first ``k`` by label.

    The rank limit works before the shuffle and the count is a plain aggregate, so even a group
    that holds most subjects never meets in one task.
    """
    by_label = Window.partitionBy(*keys).orderBy("subject_id")
    # Stored once: what makes up the members would otherwise be worked out for both.
    members = stage(members, "pilot-members")
    first = members.withColumn("_n", F.row_number().over(by_label)).filter(F.col("_n") <= k)
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("stratum_available"))
    return first.drop("_n").join(sizes, keys)


def _named(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "unknown").otherwise(value)


def paired_flair(selection: DataFrame) -> DataFrame:
    """The FLAIR of every subject that has both modalities selected."""
    place = F.struct(
        "center", "study_uid_hash", (-F.col("score")).alias("low"), "series_uid_hash"
    )
    chosen = selection.filter(
        (F.col("decision_status") == "selected") & F.col("candidate_type").isin("t1", "flair")
    )
    is_flair = F.col("candidate_type") == "flair"
    return (
        chosen.groupBy("subject_id")
        .agg(
            F.max_by(F.struct("center", "study_uid_hash", "series_uid_hash"),
                     F.when(is_flair, place)).alias("flair"),
            F.max(is_flair).alias("has_flair"),
            F.max(~is_flair).alias("has_t1"),
        )
        .filter(F.col("has_flair") & F.col("has_t1"))
        .select("subject_id", "flair.*")
    )


def pilot_strata(selection: DataFrame, series: DataFrame) -> DataFrame:
    """Paired subjects with the stratum of their FLAIR."""
    facts = ["manufacturer", "model_name", "protocol_id"]
    return series_lookup(paired_flair(selection), series, facts, "inner").select(
        "subject_id",
        "center",
        _named(F.col("manufacturer")).alias("manufacturer"),
        _named(F.col("model_name")).alias("model_name"),
        "protocol_id",
    )


def exceptional_subjects(selection: DataFrame, series: DataFrame) -> DataFrame:
    """Distinct (reason, subject) of axial reformats and of doubtful reviews."""
    facts = series_lookup(
        selection.select(*SERIES_KEYS, "decision_status"),
        series,
        ["candidate_type", "source_kind", "plane", "classification_confidence"],
        "inner",
    )
    reformat = (
        (F.col("candidate_type") == "t1")
        & (F.col("source_kind") == "derived_mpr")
        & (F.col("plane") == "axial")
    )
    doubtful = (F.col("decision_status") == "review") & (
        F.col("plane").isin("unknown", "inconsistent")
        | (F.col("classification_confidence") != "high")
    )
    reasons = F.array_compact(
        F.array(
            F.when(reformat, F.lit("axial_mpr")),
            F.when(doubtful, F.lit("review_or_low_confidence")),
        )
    )
    return facts.select(F.explode(reasons).alias("reason"), "subject_id").distinct()


def select_pilot(
    selection: DataFrame, series: DataFrame, params: PilotParams = PilotParams()
) -> DataFrame:
    """The first subjects of every stratum, and the first of every exceptional kind."""
    k = params.per_stratum
    usual = _first_subjects(pilot_strata(selection, series), STRATUM, k).select(
        "subject_id",
        "center",
        F.lit("flair_protocol_stratum").alias("reason"),
        F.concat_ws("|", *STRATUM).alias("stratum"),
        "protocol_id",
        "stratum_available",
    )
    special = _first_subjects(exceptional_subjects(selection, series), ["reason"], k)
    # At most per_stratum subjects for each of two reasons: safe to broadcast.
    wanted = F.broadcast(special.select("subject_id").distinct())
    centers = (
        series.join(wanted, "subject_id", "left_semi")
        .groupBy("subject_id")
        .agg(F.min_by("center", F.struct(*series_order())).alias("center"))
    )
    unusual = special.join(centers, "subject_id").select(
        "subject_id",
        "center",
        "reason",
        F.col("reason").alias("stratum"),
        F.lit("").alias("protocol_id"),
        "stratum_available",
    )
    return (
        usual.unionByName(unusual)
        .withColumns(
            {
                "stratum_target": F.lit(k),
                "shortfall": F.greatest(F.lit(0).cast("bigint"), k - F.col("stratum_available")),
            }
        )
        .select(*columns(PILOT))
    )


def pilot_totals(pilot: DataFrame) -> DataFrame:
    stratum = F.when(F.col("reason") == "flair_protocol_stratum", F.col("stratum"))
    return pilot.agg(
        F.countDistinct("subject_id").alias("subjects"),
        F.countDistinct(stratum).alias("strata"),
        F.countDistinct(F.when(F.col("shortfall") > 0, stratum)).alias("strata_with_shortfall"),
    )


def pilot_order() -> list[Column]:
    return [F.col(c) for c in ("center", "subject_id", "reason", "stratum")]
