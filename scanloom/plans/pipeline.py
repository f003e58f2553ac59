"""The pipelines a user starts from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.inventory import (
    inventory,
    marked_subjects,
    raise_problems,
    subject_problems,
    subject_sizes,
    without_subjects,
)
from scanloom.operators.selection import select_series
from scanloom.operators.skew import HOT_ROWS
from scanloom.operators.staging import buckets_for, stage, stage_bucketed
from scanloom.params import SelectionParams

def curate(
    instances: DataFrame, params: SelectionParams = SelectionParams(), on_problem: str = "raise", dealt: int | None = None
) -> tuple[DataFrame, ...]:
    """Instance headers to (stored series, selection).

    Labels that occur in several centers and folders without a label stop the run; with
    ``on_problem="report"`` those subjects are left out and listed in a third table.

    The series table is the natural cut: every later step reads it more than once, most of them by subject. So it
    is stored in buckets by subject. Headers move once, subject by subject, straight to their bucket, and the selection
    stays there; only where a subject has ``HOT_ROWS`` planes or more do headers move by series, and series after them.
    The number of buckets grows with the planes. ``dealt`` says that the headers are stored in so many buckets by their
    ``subject_id``, the label of the subject folder: then they do not move at all.
    """
    series, selection, problems, *_ = _curated(instances, params, on_problem, dealt)
    return (series, selection) if on_problem == "raise" else (series, selection, problems)


def curate_stored(
    instances: DataFrame, params: SelectionParams = SelectionParams(), dealt: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """As ``curate``, the selection stored in buckets by subject like the series."""
    series, selection = curate_series(instances, params, dealt)
    return series, selection()


def curate_series(
    instances: DataFrame, params: SelectionParams = SelectionParams(), dealt: int | None = None
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """As ``curate_stored``, the selection made when it is first called for: many steps only read the series."""
    series, selection, _, buckets, stays = _curated(instances, params, "raise", dealt)
    return series, cache(lambda: stage_bucketed(selection, "selection", ["subject_id"], buckets, stays))


def _curated(
    instances: DataFrame, params: SelectionParams, on_problem: str, dealt: int | None
) -> tuple[DataFrame, DataFrame, DataFrame, int, bool]:
    """Series, selection, problems, the number of buckets, and whether the selection lies in those of the series."""
    if on_problem not in ("raise", "report"):
        raise ValueError(on_problem)
    if dealt:
        sizes = stage_bucketed(subject_sizes(instances, dealt=True), "subject-sizes", ["subject_id"], dealt, dealt=True)
    else:
        sizes = stage(subject_sizes(instances), "subject-sizes")
    marked = stage(marked_subjects(sizes, HOT_ROWS), "marked-subjects")
    problems = subject_problems(instances, sizes)
    if on_problem == "report":
        problems = stage(problems, "subject-problems")
        instances, dealt = without_subjects(instances, problems), None
    elif not marked.filter("unusable").isEmpty():
        raise_problems(problems)
    crowded = marked.filter("crowded").select("subject_id")
    small = crowded.isEmpty()
    planes = sizes.agg(F.sum("planes")).first()[0] or 0
    n = dealt or buckets_for(instances.sparkSession, planes)
    if small:
        rows = inventory(instances, params, hot_rows=None, buckets=n, dealt=bool(dealt))
        series = stage_bucketed(rows, "series", ["subject_id"], n, dealt=True)
        selection = select_series(series, params, small_subjects=True)
    else:
        rows = inventory(instances, params, HOT_ROWS, crowded)
        series = stage_bucketed(rows, "series", ["subject_id"], n)
        selection = select_series(series, params)
    return series, selection, problems, n, small
