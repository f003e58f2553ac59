"""Human decisions: applying them, checking them, and the sheet they are written on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scoring import manual_basename
from scanloom.functions.text import blank, fixed_decimals, strip
from scanloom.operators.staging import stage
from scanloom.schemas import MANUAL_REVIEW, SELECTION, SERIES_KEYS, columns

# The decisions a reviewer may write.
T1_DECISIONS = ("accept_original", "accept_mpr", "accept_sag_fallback")
ALLOWED_DECISIONS = ("", *T1_DECISIONS, "accept_flair", "exclude")

KEYS = ["subject_id", "study_uid_hash", "series_uid_hash"]


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select(*keys, "_last.*")
    )


def manual_decisions(sheet: DataFrame, position: str = "position") -> DataFrame:
    """Trimmed, non-blank decisions, the last one of every series."""
    cells = sheet.select(
        *[strip(blank(F.col(c))).alias(c) for c in [*KEYS, "decision", "reviewer"]], position
    )
    return last_per_key(cells.filter(F.col("decision") != ""), KEYS, [position]).drop(position)


def _problem() -> Column:
    # The texts of these problems, which reports must match.
    decision, kind = F.col("decision"), F.col("candidate_type")
    wrong_t1 = F.concat(decision, F.lit(" may only be used for T1 candidates"))
    return (
        F.when(
            (decision == "accept_flair") & (kind != "flair"),
            "accept_flair may only be used for FLAIR candidates",
        )
        .when(decision.isin(*T1_DECISIONS) & (kind != "t1"), wrong_t1)
        .when(
            (decision == "accept_original") & (F.col("source_kind") != "original"),
            "accept_original requires an original/primary source",
        )
        .when(
            (decision == "accept_mpr") & (F.col("source_kind") != "derived_mpr"),
            "accept_mpr requires a derived MPR source",
        )
    )


def decision_violations(
    selection: DataFrame, sheet: DataFrame, position: str = "position"
) -> DataFrame:
    """Everything that makes a decision sheet unusable, one row per problem."""
    return _violations(sheet, _met(selection, manual_decisions(sheet, position)))


def _met(selection: DataFrame, decided: DataFrame) -> DataFrame:
    """The decided series of a selection with what decides whether the decision fits."""
    return selection.select(*KEYS, "candidate_type", "source_kind").join(decided, KEYS)


def _violations(sheet: DataFrame, met: DataFrame) -> DataFrame:
    raw = sheet.select(*[strip(blank(F.col(c))).alias(c) for c in [*KEYS, "decision"]])
    unknown = raw.filter(~F.col("decision").isin(*ALLOWED_DECISIONS)).select(
        *KEYS,
        F.concat(F.lit("invalid manual decision: '"), "decision", F.lit("'")).alias("problem"),
    )
    known = met.filter(F.col("decision").isin(*ALLOWED_DECISIONS))
    misplaced = known.withColumn("problem", _problem()).filter(F.col("problem").isNotNull())
    accepted = known.filter(F.col("decision") != "exclude")
    doubled = (
        accepted.groupBy("subject_id", "candidate_type")
        .agg(F.count(F.lit(1)).alias("n"), F.min("study_uid_hash").alias("study_uid_hash"),
             F.min("series_uid_hash").alias("series_uid_hash"))
        .filter(F.col("n") > 1)
        .select(
            *KEYS,
            F.concat(
                F.lit("multiple manually accepted candidates for "), "candidate_type",
                F.lit(": "), F.col("n").cast("string"),
            ).alias("problem"),
        )
    )
    return unknown.unionByName(misplaced.select(*KEYS, "problem")).unionByName(doubled)


def assert_no_violations(violations: DataFrame, shown: int = 20) -> None:
    """Fail when there is any violation; the message names the first ones and how many more there are."""
    found = violations.orderBy("problem", *KEYS).limit(shown).collect()
    if found:
        more = violations.count() - len(found)
        tail = f"; and {more} more" if more else ""
        raise ValueError("; ".join(r.problem for r in found) + tail)


def _usable(met: DataFrame) -> DataFrame:
    """Decided series whose decision may be applied: known, fit for the series, and the only acceptance."""
    fit = met.filter(F.col("decision").isin(*ALLOWED_DECISIONS) & _problem().isNull())
    accepted = F.count_if(F.col("decision") != "exclude")
    rivals = (
        fit.groupBy("subject_id", "candidate_type").agg(accepted.alias("n")).filter(F.col("n") > 1)
        .select("subject_id", "candidate_type", F.lit(True).alias("_rivals"))
    )
    judged = fit.join(rivals, ["subject_id", "candidate_type"], "left")
    return judged.filter((F.col("decision") == "exclude") | F.col("_rivals").isNull()).drop("_rivals")


def apply_manual_decisions(
    selection: DataFrame, sheet: DataFrame, position: str = "position", on_problem: str = "raise"
) -> DataFrame:
    """Override automatic decisions and retire the rivals of an accepted series.

    A sheet with violations stops the run; with ``on_problem="leave"`` the rows that they concern stay
    as they are (``decision_violations`` lists them). Start from the automatic selection: decisions
    are not meant to be applied to their own result.
    """
    # What the checks, the winners and the rows need is stored once: one row per decided series.
    met = stage(_met(selection, manual_decisions(sheet, position)), "decided-series")
    if on_problem == "raise":
        assert_no_violations(_violations(sheet, met))
    elif on_problem == "leave":
        met = _usable(met)
    else:
        raise ValueError(on_problem)
    decided = met.select(*KEYS, "decision", F.col("reviewer").alias("_reviewer")).distinct()
    rows = selection.join(decided, KEYS, "left")
    accepted = (
        met.filter(F.col("decision") != "exclude")
        .groupBy("subject_id", "candidate_type")
        .agg(F.min("series_uid_hash").alias("_winner"))
    )
    rows = rows.join(accepted, ["subject_id", "candidate_type"], "left")
    touched, excluded = F.col("decision").isNotNull(), F.col("decision") == "exclude"
    superseded = F.col("_winner").isNotNull() & (F.col("series_uid_hash") != F.col("_winner"))
    accepted_name = manual_basename(
        F.col("subject_id"), F.col("candidate_type"), F.col("decision")
    )
    return rows.withColumns(
        {
            "decision_status": F.when(superseded | excluded, "excluded")
            .when(touched, "selected")
            .otherwise(F.col("decision_status")),
            "reason": F.when(superseded, "superseded_by_manual_selection")
            .when(excluded, "manual_exclusion")
            .when(touched, F.concat(F.lit("manual_"), "decision"))
            .otherwise(F.col("reason")),
            "output_basename": F.when(superseded | excluded, "")
            .when(touched, accepted_name)
            .otherwise(F.col("output_basename")),
            "reviewer": F.when(touched, F.col("_reviewer")).otherwise(F.col("reviewer")),
            "manual_decision": F.when(touched, F.col("decision")).otherwise(
                F.col("manual_decision")
            ),
        }
    ).select(*columns(SELECTION))


def series_lookup(rows: DataFrame, series: DataFrame, wanted: list[str], how: str) -> DataFrame:
    """Bring series facts to rows that carry the full series key."""
    return rows.join(series.select(*SERIES_KEYS, *wanted), SERIES_KEYS, how)


def missing_series(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Rows whose series is not in the inventory."""
    return rows.join(series.select(*SERIES_KEYS), SERIES_KEYS, "left_anti")


def assert_all_found(rows: DataFrame, series: DataFrame, shown: int = 20) -> None:
    """Fail when any row's series is not in the inventory; names the first ones and how many more there are."""
    lost = missing_series(rows, series).select("subject_id", "series_uid_hash")
    found = lost.orderBy("subject_id", "series_uid_hash").limit(shown).collect()
    if found:
        more = lost.count() - len(found)
        tail = f"; and {more} more" if more else ""
        raise ValueError("series not in the inventory: " + ", ".join(f"sub-{r[0]} {r[1]}" for r in found) + tail)


def review_sheet(
    selection: DataFrame, series: DataFrame, prior: DataFrame | None = None,
    position: str = "position", on_missing: str = "raise",
) -> DataFrame:
    """Rows in review or already decided, keeping what people wrote on the prior sheet.

    A row whose series is not in the inventory stops the run; with ``on_missing="leave"`` it has no facts.
    """
    open_rows = selection.filter(
        (F.col("decision_status") == "review") | (F.col("manual_decision") != "")
    )
    if on_missing == "raise":
        assert_all_found(open_rows, series)
    elif on_missing != "leave":
        raise ValueError(on_missing)
    facts = ["series_description", "protocol_name", "plane_angle_deg"]
    sheet = series_lookup(open_rows, series, facts, "left").withColumns(
        {
            "score": fixed_decimals(F.col("score"), 6),
            "decision": F.col("manual_decision"),
            "comments": F.lit(""),
        }
    )
    if prior is None:
        return sheet.select(*columns(MANUAL_REVIEW))
    human = ["decision", "reviewer", "comments"]
    written = prior.select(
        *[blank(F.col(c)).alias(c) for c in KEYS],
        *[blank(F.col(c)).alias(f"_{c}") for c in human],
        position,
    )
    merged = sheet.join(
        last_per_key(written, KEYS, [position]).drop(position), KEYS, "left"
    )
    return merged.withColumns(
        {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in human}
    ).select(*columns(MANUAL_REVIEW))
