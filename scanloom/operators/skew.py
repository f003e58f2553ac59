"""Finding keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
HOT_KEYS = 10_000


def hot_keys(
    df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, max_keys: int = HOT_KEYS,
    rows: Column | None = None,
) -> DataFrame:
    """The keys with at least ``hot_rows`` rows, largest first, never more than ``max_keys``.

    ``rows`` says how many rows one row will become. The limit is the proof that the result may be
    broadcast. A key that is left out by it holds less than one ``max_keys``-th of all rows, so the
    ordinary path can take it; both paths must give equal results.
    """
    counted = df.groupBy(*keys).agg(F.sum(F.lit(1) if rows is None else rows).alias("n_rows"))
    return (
        counted.filter(F.col("n_rows") >= hot_rows)
        .orderBy(F.desc("n_rows"), *keys)
        .limit(max_keys)
        .select(*keys)
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    """Join condition that lets null keys meet."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null meets null; the keys come once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
