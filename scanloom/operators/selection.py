"""Choosing one T1 and one FLAIR per subject, with a recorded reason for every series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions.scoring import output_basename, score
from scanloom.operators.skew import join_null_safe
from scanloom.operators.staging import stage
from scanloom.params import SelectionParams
from scanloom.schemas import SELECTION, SERIES_KEYS, columns

POOLS = ("t1_original", "t1_mpr", "flair")


def scored(series: DataFrame, params: SelectionParams = SelectionParams()) -> DataFrame:
    return series.withColumn("score", score(params))


def _pool(params: SelectionParams) -> Column:
    axial_t1 = (F.col("candidate_type") == "t1") & (F.col("plane") == "axial")
    mpr = axial_t1 & (F.col("source_kind") == "derived_mpr")
    return (
        F.when(axial_t1 & (F.col("source_kind") == "original"), "t1_original")
        .when(mpr & F.lit(params.allow_axial_mpr_fallback), "t1_mpr")
        .when(F.col("candidate_type") == "flair", "flair")
    )


def _entry() -> Column:
    return F.struct("score", "series_uid_hash", "sure")


def _sure() -> Column:
    return (F.col("classification_confidence") == "high") & F.col("orientation_consistent")


def _best() -> Window:
    return Window.partitionBy("subject_id", "pool").orderBy(F.desc("score"), "series_uid_hash")


def _facts() -> dict[str, Column]:
    """Aggregates: the two best of every pool, more than one study."""
    leaders = {
        f"{pool}_{place}": F.max(F.when((F.col("pool") == pool) & (F.col("place") == place), F.col("entry")))
        for pool in POOLS
        for place in (1, 2)
    }
    return leaders | {"studies": F.min("study_uid_hash") != F.max("study_uid_hash")}


def subject_facts(rows: DataFrame) -> DataFrame:
    """What the decision about a subject needs: the two best of every pool, more than one study.

    ``row_number() <= 2`` is cut to two rows per subject and pool before the shuffle, and the rest
    are plain aggregates, so a subject of any size costs no task more than its share.
    """
    top = (
        rows.filter(F.col("pool").isNotNull())
        .select("subject_id", "pool", "score", "series_uid_hash", _sure().alias("sure"))
        .withColumn("place", F.row_number().over(_best()))
        .filter(F.col("place") <= 2)
    )
    # The leaders and every row's study go into one aggregate, which is one exchange and no join.
    both = top.select("subject_id", "pool", "place", _entry().alias("entry")).unionByName(
        rows.select("subject_id", "study_uid_hash"), allowMissingColumns=True
    )
    return both.groupBy("subject_id").agg(*[c.alias(n) for n, c in _facts().items()])


def _with_facts(rows: DataFrame) -> DataFrame:
    """``rows`` with the facts of their subject, each subject in one task: rows that lie by subject do not move.

    A hash leads the one sort, as labels begin too much alike to be told apart by their first bytes."""
    whole = Window.partitionBy("subject_no", "subject_id")
    best = Window.partitionBy("subject_no", "subject_id", "pool").orderBy(F.desc("score"), "series_uid_hash")
    numbered = rows.withColumns({"sure": _sure(), "subject_no": F.xxhash64("subject_id")})
    placed = numbered.withColumns({"place": F.row_number().over(best), "entry": _entry()})
    facts = _facts()
    first, last = F.min("study_uid_hash").over(whole), F.max("study_uid_hash").over(whole)
    leaders = {n: c.over(whole) for n, c in facts.items() if n != "studies"}
    return placed.withColumns(leaders | {"studies": first != last})


def select_series(
    series: DataFrame, params: SelectionParams = SelectionParams(), small_subjects: bool = False
) -> DataFrame:
    """One selection row per series.

    Scores and pools are worked out once and stored with the few columns that the decision needs;
    that table is read three times. Subjects without a label meet each other, as in the inventory.
    ``small_subjects`` says that any subject's rows fit a task: then nothing is stored, and a series
    table in buckets by subject is read once and not moved. Both ways give equal rows.
    """
    rows = scored(series, params).select(
        *SERIES_KEYS, "candidate_type", "plane", "source_kind", "protocol_id", "score",
        "classification_confidence", "orientation_consistent", _pool(params).alias("pool"),
    )
    if small_subjects:
        with_facts = _with_facts(rows)
    else:
        rows = stage(rows, "scored-series")
        with_facts = join_null_safe(rows, subject_facts(rows), ["subject_id"])
    joined = with_facts.withColumns(
        {
            "multiple_studies": F.coalesce("studies", F.lit(False)),
            "t1_pool": F.when(F.col("t1_original_1").isNotNull(), "t1_original").when(
                F.col("t1_mpr_1").isNotNull(), "t1_mpr"
            ),
            "t1_1": F.coalesce("t1_original_1", "t1_mpr_1"),
            "t1_2": F.when(F.col("t1_original_1").isNotNull(), F.col("t1_original_2")).otherwise(
                F.col("t1_mpr_2")
            ),
        }
    )

    def within(other: Column, top: Column) -> Column:
        return F.coalesce(top - other <= params.manual_review_margin, F.lit(False))

    own, this = F.col("score"), F.col("series_uid_hash")
    t1_top, fl_top = F.col("t1_1"), F.col("flair_1")
    t1_tie = within(F.col("t1_2.score"), t1_top["score"])
    fl_tie = within(F.col("flair_2.score"), fl_top["score"])
    in_pool = F.coalesce(F.col("pool") == F.col("t1_pool"), F.lit(False))
    is_t1_top = in_pool & (this == t1_top["series_uid_hash"])
    is_fl_top = this == fl_top["series_uid_hash"]
    is_fl_second = F.coalesce(this == F.col("flair_2.series_uid_hash"), F.lit(False))

    def verdict(status: str, reason: str) -> Column:
        return F.struct(F.lit(status).alias("decision_status"), F.lit(reason).alias("reason"))

    t1 = (
        F.when(F.col("t1_pool").isNull(), verdict("review", "no_reliable_axial_t1"))
        .when(t1_tie & in_pool & within(own, t1_top["score"]), verdict("review", "t1_near_tie"))
        .when(t1_tie | ~is_t1_top, verdict("excluded", "lower_ranked_t1"))
        .when(F.col("source_kind") == "original", verdict("selected", "best_original_axial_t1"))
        .otherwise(verdict("selected", "axial_mpr_fallback"))
    )
    flair = (
        F.when(~fl_top["sure"] & is_fl_top, verdict("review", "flair_low_confidence"))
        .when(
            fl_top["sure"] & fl_tie & (is_fl_top | is_fl_second),
            verdict("review", "flair_near_tie"),
        )
        .when(fl_top["sure"] & is_fl_top, verdict("selected", "best_wmh_flair"))
        .otherwise(verdict("excluded", "lower_ranked_flair"))
    )
    decided = (
        F.when(F.col("candidate_type") == "other", verdict("excluded", "not_t1_or_flair"))
        .when(F.col("multiple_studies"), verdict("review", "multiple_studies"))
        .when(F.col("candidate_type") == "t1", t1)
        .otherwise(flair)
    )
    chosen = joined.withColumn("_decided", decided).select(
        *SERIES_KEYS,
        "candidate_type",
        "_decided.*",
        "score",
        F.col("plane").alias("source_plane"),
        "source_kind",
        "protocol_id",
        F.lit("").alias("reviewer"),
        F.lit("").alias("manual_decision"),
    )
    named = chosen.withColumn(
        "output_basename",
        output_basename(
            F.col("subject_id"), F.col("candidate_type"), F.col("source_kind"),
            F.col("decision_status"),
        ),
    )
    return named.select(*columns(SELECTION))


def selection_order() -> list[Column]:
    return [
        F.col("center"),
        F.col("subject_id"),
        F.col("study_uid_hash"),
        F.col("candidate_type"),
        F.desc("score"),
        F.col("series_uid_hash"),
    ]


def both_modalities(selection: DataFrame) -> DataFrame:
    """Subjects whose selected modalities are exactly T1 and FLAIR."""
    chosen = selection.filter(
        (F.col("decision_status") == "selected") & F.col("candidate_type").isin("t1", "flair")
    )
    kinds = F.array_sort(F.collect_set("candidate_type"))
    return (
        chosen.groupBy("subject_id")
        .agg(kinds.alias("kinds"))
        .filter(F.col("kinds") == F.array(F.lit("flair"), F.lit("t1")))
        .select("subject_id")
    )
