"""Planning conversion work against inventory, prior state and existing files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.scoring import suffix_of
from scanloom.functions.text import blank, path_sort_key, subject_label
from scanloom.operators.ordering import range_chunks, running_totals
from scanloom.params import WorkParams
from scanloom.schemas import ASSET_DIFF, RESULTS, SERIES_KEYS, columns

# Stages in which a worker holds a series, and messages recorded with a result.
OWNED_STAGES = ("linking", "dcm2niix", "compressing", "validating", "installing")
DONE_STAGES = ("converted", "review_ready")
# What a state may tell a result, beside what decides about it.
_RECORDED = {
    "started_at": "string", "finished_at": "string", "log_path": "string", "worker_pid": "bigint",
    "child_pid": "bigint",
}
MISSING_MESSAGE = "series missing from private inventory"
OWNED_MESSAGE = "another live worker owns this series"
PRIOR_FAILURE_MESSAGE = "prior failure; use --retry-failed"


def only_subjects(rows: DataFrame, subjects: DataFrame | None) -> DataFrame:
    """Restrict to a list of subjects; labels are normalised first."""
    if subjects is None:
        return rows
    wanted = subjects.select(subject_label(F.col("subject_id")).alias("subject_id")).distinct()
    return rows.join(wanted, "subject_id", "left_semi")


def convertible(
    selection: DataFrame, params: WorkParams = WorkParams(), subjects: DataFrame | None = None
) -> DataFrame:
    """Selected rows, and review rows where those are converted too."""
    statuses = ["selected", "review"] if params.convert_review_candidates else ["selected"]
    rows = only_subjects(selection.filter(F.col("decision_status").isin(statuses)), subjects)
    mode = F.when(F.col("decision_status") == "selected", "selected").otherwise("review")
    return rows.withColumn("mode", mode)


def dry_run(work: DataFrame) -> DataFrame:
    return work.select(
        "subject_id", "series_uid_hash", "candidate_type", F.lit("dry_run").alias("status"),
        "mode", F.col("output_basename").alias("output_path"), F.col("reason").alias("message"),
    )


def missing_from_inventory(work: DataFrame, series: DataFrame) -> DataFrame:
    """Work whose series is not in the inventory, as failed results."""
    return work.join(series.select(*SERIES_KEYS), SERIES_KEYS, "left_anti").select(
        "subject_id", "series_uid_hash", "candidate_type",
        F.lit("failed").alias("status"), F.lit("inventory").alias("mode"),
        F.lit(MISSING_MESSAGE).alias("message"),
    )


def _packed(sha256: Column) -> Column:
    """A digest in half its room; any other text as it is, marked so that the two never meet."""
    text = F.concat(F.lit(b"\x00"), sha256.cast("binary"))
    return F.when(sha256.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.lit(b"\x01"), F.unhex(sha256))).otherwise(text)


def _recorded(kind: str) -> Column:
    return F.struct(F.col(f"{kind}_path").alias("path"), _packed(F.col(f"{kind}_sha256")).alias("sha256"))


def _found_unchanged(state: DataFrame, keys: list[str], digests: DataFrame, tasks: int | None) -> DataFrame:
    """Per series of finished states, the paths and digests they record whose files are found with these digests.

    Only what is looked for goes to the files, path by path, and only what is found comes back.
    """
    recorded = F.array(*[F.when(F.col(f"{k}_sha256") != "", _recorded(k)) for k in ("output", "sidecar")])
    finished = state.filter(F.col("stage").isin(*DONE_STAGES)).select(*keys, F.explode(recorded).alias("_wanted"))
    wanted = finished.select(*keys, "_wanted.*")
    found = digests.select(F.col("path").alias("_path"), _packed(F.col("sha256")).alias("_now"))
    if tasks:
        found = found.repartition(tasks, "_path")
    same = wanted.join(found, (F.col("path") == F.col("_path")) & (F.col("sha256") == F.col("_now")), "left_semi")
    if tasks:
        same = same.repartition(tasks, *keys)
    return same.groupBy(*keys).agg(F.collect_set(F.struct("path", "sha256")).alias("_found"))


def resume_decisions(
    work: DataFrame, state: DataFrame, digests: DataFrame, params: WorkParams = WorkParams(), tasks: int | None = None
) -> DataFrame:
    """What to do with each piece of work, given its last state and the files found now.

    ``state`` has one row per series (stage, output_path, output_sha256, sidecar_path,
    sidecar_sha256, message, owner_alive and what else a result records); ``digests`` one per file
    (path, sha256). State is joined on as much of the series key as it has. ``tasks`` says in how many tasks work and
    files meet the states; without it Spark's own number holds, whatever the size.
    """
    keys = [c for c in SERIES_KEYS if c in state.columns and c in work.columns]
    found = _found_unchanged(state, keys, digests, tasks)
    known = [c for c in columns(RESULTS) if c in state.columns]
    state = state.withColumns(
        {c: F.lit(None).cast(t) for c, t in _RECORDED.items() if c not in known}
    ).drop(*[c for c in ("candidate_type", "mode", "status") if c in state.columns])
    if tasks:
        work = work.repartition(tasks, *keys)
    joined = work.join(state, keys, "left").join(found, keys, "left")
    stage = blank(F.col("stage"))

    def unchanged(kind: str) -> Column:
        return F.coalesce(F.array_contains("_found", _recorded(kind)), F.lit(False))

    verified = stage.isin(*DONE_STAGES) & unchanged("output") & unchanged("sidecar")
    preserved = (stage == "failed") & F.lit(not params.retry_failed)
    owned = stage.isin(*OWNED_STAGES) & F.coalesce(F.col("owner_alive"), F.lit(False))
    resume = F.lit(params.resume)

    def outcome(status: str, mode: str | Column, message: str | Column) -> Column:
        as_column = [m if isinstance(m, Column) else F.lit(m) for m in (mode, message)]
        return F.struct(
            F.lit(status).alias("status"), as_column[0].alias("mode"), as_column[1].alias("message")
        )

    verdict = (
        F.when(
            resume & verified,
            outcome("skipped", "resume",
                    F.concat(F.lit("verified prior "), stage, F.lit(" output"))),
        )
        .when(
            resume & preserved,
            outcome("failed", "preserved_failure",
                    F.coalesce("message", F.lit(PRIOR_FAILURE_MESSAGE))),
        )
        .when(resume & owned, outcome("skipped", "active_worker", OWNED_MESSAGE))
        .otherwise(outcome("run", F.col("mode"), ""))
    )
    mode = F.col("_verdict.mode")
    verified, ended = mode == "resume", mode.isin("resume", "preserved_failure")
    owned = mode == "active_worker"

    def text(name: str, when: Column) -> Column:
        return F.when(when, blank(F.col(name))).otherwise("").alias(name)

    return joined.withColumn("_verdict", verdict).select(
        "subject_id", "series_uid_hash", "candidate_type", "_verdict.*",
        *[text(c, verified) for c in ("output_path", "output_sha256", "sidecar_path", "sidecar_sha256")],
        *[text(c, ended) for c in ("started_at", "finished_at", "log_path")],
        *[F.when(owned, F.col(c)).alias(c) for c in ("worker_pid", "child_pid")],
    )


def execution_order(work: DataFrame) -> DataFrame:
    """Subjects together in one partition, their series in order."""
    return work.repartition("subject_id").sortWithinPartitions(
        "subject_id", "candidate_type", "series_uid_hash"
    )


def failed_count(results: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return results.agg(
        F.count_if(failed).alias("failed"),
        F.coalesce(F.bool_or(failed), F.lit(False)).alias("any_failed"),
    )


def asset_diff(incoming: DataFrame, assets: DataFrame) -> DataFrame:
    """What installing the selected series changes: a row per replaced file, or one addition."""
    place = r"^sub-([^/]+)/anat/[^/]*(T1w|FLAIR)\.(nii[^/]*|json)$"
    existing = (
        assets.withColumns(
            {
                "subject_id": F.regexp_extract("relpath", place, 1),
                "modality": F.regexp_extract("relpath", place, 2),
            }
        )
        .filter(F.col("modality") != "")
        .select(
            "subject_id", "modality", F.col("relpath").alias("old_path"),
            F.col("sha256").alias("old_sha256"),
        )
    )
    target = F.concat(
        F.lit("sub-"), "subject_id", F.lit("/anat/"), "output_basename", F.lit(".nii.gz")
    )
    planned = incoming.withColumns(
        {"modality": suffix_of(F.col("candidate_type")), "new_path": target}
    )
    return (
        planned.join(existing, ["subject_id", "modality"], "left")
        .withColumn("action", F.when(F.col("old_path").isNull(), "added").otherwise("replaced"))
        .withColumns({c: blank(F.col(c)) for c in ("old_path", "old_sha256")})
        .select(*columns(ASSET_DIFF))
    )


def diff_log_merge(prior: DataFrame, new: DataFrame) -> DataFrame:
    return prior.unionByName(new).dropDuplicates()


def copy_plan(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Files that have to be copied; equal size and time, or equal link target, means present.

    Both sides list (relpath, length, mtime) and may add ``link_target`` for symbolic links.
    """

    def listing(df: DataFrame) -> DataFrame:
        link = F.col("link_target") if "link_target" in df.columns else F.lit(None).cast("string")
        return df.select("relpath", "length", "mtime", link.alias("link_target"))

    there = listing(destination).select(
        "relpath", *[F.col(c).alias(f"_{c}") for c in ("length", "mtime", "link_target")],
        F.lit(True).alias("_found"),
    )
    is_link = F.col("link_target").isNotNull()
    same = F.when(is_link, F.col("link_target").eqNullSafe(F.col("_link_target"))).otherwise(
        F.col("_link_target").isNull()
        & (F.col("length") == F.col("_length"))
        & (F.col("mtime") == F.col("_mtime"))
    )
    plan = listing(source).join(there, "relpath", "left")
    return plan.filter(~F.coalesce(F.col("_found") & same, F.lit(False))).select(
        "relpath", F.when(is_link, 0).otherwise(F.col("length")).alias("length"), "mtime",
        "link_target",
    )


def copy_totals(listing: DataFrame) -> DataFrame:
    return listing.agg(
        F.count(F.lit(1)).alias("files_total"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_total"),
    )


def copy_progress(
    listing: DataFrame, seconds_per_byte: float, every: int = 128,
    order: Sequence[str] = ("_path_key",),
) -> DataFrame:
    """Running totals at each ``every``-th file and at the last, in path order.

    Elapsed time is modelled from the bytes done when the listing has no ``elapsed_seconds``.
    """
    keyed = listing.withColumn("_path_key", path_sort_key(F.col("relpath")))
    chunked = range_chunks(keyed, list(order), "copy-listing")
    done = running_totals(
        chunked, list(order), {"files_completed": F.lit(1), "bytes_completed": F.col("length")}
    )
    # One aggregate row.
    totals = F.broadcast(copy_totals(chunked).withColumn("_one", F.lit(1)))
    marks = done.withColumn("_one", F.lit(1)).join(totals, "_one").filter(
        (F.col("files_completed") % every == 0)
        | (F.col("files_completed") == F.col("files_total"))
    )
    elapsed = (
        F.col("elapsed_seconds") if "elapsed_seconds" in listing.columns
        else F.col("bytes_completed") * F.lit(seconds_per_byte)
    )
    speed = F.col("bytes_completed") / F.greatest(elapsed, F.lit(1e-6))
    remaining = F.greatest(F.lit(0), F.col("bytes_total") - F.col("bytes_completed"))
    return marks.withColumn("speed_bytes_per_second", speed).select(
        "relpath", "files_completed", "bytes_completed", "files_total", "bytes_total",
        "speed_bytes_per_second",
        F.try_divide(remaining, F.col("speed_bytes_per_second")).alias("eta_seconds"),
    )
