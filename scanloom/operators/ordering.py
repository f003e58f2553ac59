"""Order-dependent results (running totals, previous row, rank) over one global order.

A window without a small partition key would put all rows into one task. Here the rows are
range-partitioned by the order itself into as many chunks as there are shuffle partitions. Each
chunk is worked on alone, and what flows from chunk to chunk is one summary row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.staging import stage

CHUNK = "_chunk"


def range_chunks(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Rows with a chunk number that grows with ``order``; written out so that it cannot change.

    ``order`` must be a total order: rows that tie on it would be torn apart arbitrarily.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn(CHUNK, F.spark_partition_id())
    return stage(ranged, label)


def _earlier_chunks() -> Window:
    return Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def running_totals(
    chunked: DataFrame, order: Sequence[str], totals: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums along the global order."""
    sums = chunked.groupBy(CHUNK).agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    # One row per chunk, so at most spark.sql.shuffle.partitions rows: safe to order and broadcast.
    offsets = sums.select(
        CHUNK,
        *[F.coalesce(F.sum(f"_{n}").over(_earlier_chunks()), F.lit(0)).alias(f"_{n}")
          for n in totals],
    )
    inside = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = chunked.join(F.broadcast(offsets), CHUNK)
    return joined.select(
        *[c for c in chunked.columns],
        *[(F.sum(c).over(inside) + F.col(f"_{n}")).alias(n) for n, c in totals.items()],
    )


def previous_row(
    chunked: DataFrame, order: Sequence[str], columns: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Add the columns of the row just before in the global order (null for the very first)."""
    names = [f"{prefix}{c}" for c in columns]
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    last = chunked.groupBy(CHUNK).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    )
    # One row per chunk again; empty chunks have no row, so lag meets the nearest non-empty one.
    carried = last.select(CHUNK, F.lag("_last").over(Window.orderBy(CHUNK)).alias("_carried"))
    row = F.struct(*columns)
    before = F.coalesce(F.lag(row).over(inside), F.col("_carried"))
    return (
        chunked.join(F.broadcast(carried), CHUNK)
        .withColumn("_before", before)
        .select(*chunked.columns, *[F.col("_before")[c].alias(n) for c, n in zip(columns, names)])
    )
