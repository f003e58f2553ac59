"""Lifecycle of the work: latest states, progress, stale owners, resource samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.params import ResourceMinimums

# The stages of a series, and the texts and labels that reports must match.
TERMINAL_STAGES = ("converted", "review_ready", "failed", "skipped", "interrupted", "dry_run")
ACTIVE_STAGES = ("queued", "linking", "dcm2niix", "compressing", "validating", "installing")
STALE_MESSAGE = "worker PID is no longer alive; task is eligible for resume"
RATE_COUNTERS = ("disk_write_bytes", "network_sent_bytes", "nfs_write_bytes")
RESOURCE_LABELS = {
    "work_free_gb": "work filesystem free space",
    "staging_free_gb": "staging filesystem free space",
    "memory_available_gb": "available memory",
}


def latest_state(
    events: DataFrame, key: str = "series_uid_hash", order: Sequence[str] = ("ts",)
) -> DataFrame:
    """The last event of every key."""
    rest = [c for c in events.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def merged_state(
    events: DataFrame, key: str, order: Sequence[str], keep_first: Sequence[str] = ("started_at", "worker_pid"), cleared: str = "cleared",
) -> DataFrame:
    """Keyed merge of partial updates: the last non-null value of every attribute wins, except
    for ``keep_first`` columns, where the first one stays.

    An update may name attributes to clear in the array column ``cleared``: their value is null until
    a later update sets it.
    """
    place = F.struct(*order)
    rest = [c for c in events.columns if c not in (key, cleared, *order)]
    clears = cleared in events.columns

    def merged(c: str) -> Column:
        told = F.col(c).isNotNull()
        if clears:
            told = told | F.coalesce(F.array_contains(cleared, c), F.lit(False))
        pick = F.min_by if c in keep_first else F.max_by
        return pick(F.col(c), F.when(told, place)).alias(c)

    return events.groupBy(key).agg(
        *[merged(c) for c in rest], *[F.max(c).alias(c) for c in order]
    )


def in_scope(states: DataFrame, scope: DataFrame | None, key: str = "series_uid_hash") -> DataFrame:
    """States of the series that belong to the run; all of them without a list."""
    return states if scope is None else states.join(scope.select(key).distinct(), key, "left_semi")


def run_progress(
    states: DataFrame, elapsed_seconds: Column, total: int | None = None
) -> DataFrame:
    """Completed, total, percent, rate and remaining time; ``elapsed_seconds`` is an aggregate."""
    facts = states.agg(
        F.count_if(F.col("stage").isin(*TERMINAL_STAGES)).alias("completed"),
        F.lit(total).cast("bigint").alias("_given"),
        F.count(F.lit(1)).alias("_rows"),
        F.greatest(F.lit(0.0), F.coalesce(elapsed_seconds, F.lit(0.0))).alias("elapsed_seconds"),
    ).withColumn("total", F.coalesce(F.nullif(F.col("_given"), F.lit(0)), F.col("_rows")))
    rate = F.coalesce(F.try_divide(F.col("completed"), F.col("elapsed_seconds")), F.lit(0.0))
    left = F.col("total") - F.col("completed")
    return facts.withColumn("_rate", rate).select(
        "completed",
        "total",
        F.round(
            F.coalesce(F.try_divide(F.col("completed") * 100.0, F.col("total")), F.lit(0.0)), 2
        ).alias("percent"),
        F.round(F.col("_rate") * 60, 3).alias("series_per_minute"),
        F.when(left > 0, F.round(F.try_divide(left, F.col("_rate")), 1)).alias("eta_seconds"),
    )


def stale_series(states: DataFrame, alive: Column) -> DataFrame:
    """Active series whose owner is gone, as the state they are to get."""
    return states.filter(
        F.col("stage").isin(*ACTIVE_STAGES) & ~F.coalesce(alive, F.lit(False))
    ).withColumns({"stage": F.lit("interrupted"), "message": F.lit(STALE_MESSAGE)})


def resource_blockers(
    samples: DataFrame, minimums: ResourceMinimums, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per sample and floor it falls below."""
    checks = [
        (name, label, getattr(minimums, name))
        for name, label in RESOURCE_LABELS.items()
        if getattr(minimums, name)
    ]
    found = [
        F.when(
            F.col(name) < floor,
            F.struct(
                F.lit(name).alias("metric"),
                F.format_string(
                    f"{label} %.1f GiB is below {floor:.1f} GiB", F.col(name)
                ).alias("message"),
            ),
        )
        for name, label, floor in checks
    ]
    if not found:
        return samples.select(
            *keep, F.lit("").alias("metric"), F.lit("").alias("message")
        ).filter(F.lit(False))
    return samples.select(*keep, F.inline(F.array_compact(F.array(*found))))


def counter_rates(
    samples: DataFrame,
    counters: Sequence[str] = RATE_COUNTERS,
    key: Sequence[str] = ("host",),
    order: Sequence[str] = ("ts",),
    stretch: str = "1 hour",
) -> DataFrame:
    """Per-second change of counters since the previous sample of the same key, else 0.

    Samples meet by key and stretch of time, so a key with most of the samples is worked on in as many
    tasks as it has stretches. The last sample of each stretch, one row, is put at the head of the key's
    next one as its first predecessor.
    """
    ts = order[0]
    micros = F.unix_micros(F.col(ts))
    kept = [*key, *order, *counters]
    placed = samples.withColumns({"_stretch": F.floor(micros / _micros(stretch)), "_seed": F.lit(False)})
    last = placed.groupBy(*key, "_stretch").agg(
        F.max_by(F.struct(*order, *counters), F.struct(*order)).alias("_last")
    )
    following = F.lead("_stretch").over(Window.partitionBy(*key).orderBy("_stretch"))
    seeds = last.withColumn("_stretch", following).filter(F.col("_stretch").isNotNull()).select(
        *key, "_stretch", "_last.*", F.lit(True).alias("_seed")
    )
    inside = Window.partitionBy(*key, "_stretch").orderBy(*order)
    before = F.lag(F.struct(*kept)).over(inside)
    paired = placed.unionByName(seeds, allowMissingColumns=True).withColumn("_before", before)
    elapsed = (micros - F.unix_micros(F.col(f"_before.{ts}"))) / 1e6

    def rate(c: str) -> Column:
        change = F.col(c).cast("double") - F.col(f"_before.{c}").cast("double")
        return F.coalesce(F.when(elapsed > 0, change / elapsed), F.lit(0.0))

    return paired.filter(~F.col("_seed")).select(
        *samples.columns, *[rate(c).alias(f"{c}_per_second") for c in counters]
    )


def _micros(stretch: str) -> int:
    """Length of a stretch such as ``1 hour`` in microseconds."""
    number, unit = stretch.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(number) * seconds * 1_000_000


def latest_sample(samples: DataFrame, rates: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rates of the last sample; text that is not a number becomes null."""
    last = samples.orderBy(*[F.desc(c) for c in order]).limit(1)
    return last.select(*[F.col(c).try_cast("double").alias(c) for c in rates])


def check_rollup(checks: DataFrame) -> DataFrame:
    """Errors are failed checks of severity error; warnings are all checks of that severity."""
    errors = F.count_if(~F.col("passed") & (F.col("severity") == "error"))
    return checks.agg(
        errors.alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        (errors == 0).alias("passed"),
    )


def counts_by_stage(states: DataFrame) -> DataFrame:
    stage = F.coalesce("stage", F.lit("unknown")).alias("stage")
    return states.groupBy(stage).agg(F.count(F.lit(1)).alias("n"))
