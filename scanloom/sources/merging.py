"""Tables that are updated where they lie, a few partitions at a time.

A table is a Parquet folder, partitioned by a hash of its key. An update reads only the partitions that its rows fall
into, merges, stores the result, and lets it replace those partitions in one job: rows of other keys are not read, and
a job that fails before its commit leaves the table as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.operators.lifecycle import merged_state
from scanloom.operators.participants import participants_upsert
from scanloom.operators.staging import COMPRESSION, buckets_for, release, stage
from scanloom.schemas import ASSET_DIFF, columns

BUCKET = "_bucket"
BUCKETS = 256


def bucket_of(keys: Sequence[Column], buckets: int) -> Column:
    """The partition of a key; null is a value like others."""
    return F.pmod(F.xxhash64(*[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys]), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, with columns that only some partitions have; None if there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place) or not any(s.isDirectory() for s in files.listStatus(place)):
        return None
    return spark.read.option("mergeSchema", True).parquet(path)


def _layout(spark: SparkSession, path: str, buckets: int) -> tuple[str, int]:
    """Where a table's partitions are, and how many; the number is part of the path, so it cannot change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    known = [int(name.removeprefix("buckets=")) for name in found if name.startswith("buckets=")]
    n = known[0] if known else buckets
    return f"{path}/buckets={n}", n


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table kept by ``upsert``; None before the first."""
    inner, _ = _layout(spark, path, BUCKETS)
    rows = read_table(spark, inner)
    return None if rows is None else rows.drop(BUCKET)


def upsert(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], row_keys: Sequence[Column],
    merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS, whole_rows: bool = False,
) -> list[int]:
    """Merge ``rows`` into the table and return the partitions that were written.

    ``row_keys`` give a row the key that the table has in its columns ``keys``; ``merge`` gets the table's rows of the
    touched partitions (None for an empty table) and the new rows, and must not change the key of a row. With
    ``whole_rows`` it only drops rows, and gets all in one, gathered by partition: none moves after that.
    """
    # Tables under this name last as long as the call: the table has all that is kept.
    work = f"merge-{uuid.uuid4().hex}"
    try:
        return _upsert(spark, path, rows, keys, row_keys, merge, buckets, whole_rows, work)
    finally:
        release(spark, work)


def _upsert(
    spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], row_keys: Sequence[Column],
    merge: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int, whole_rows: bool, work: str,
) -> list[int]:
    inner, n = _layout(spark, path, buckets)
    new = stage(rows.withColumn(BUCKET, bucket_of(row_keys, n)), f"{work}-rows")
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most as many as there are partitions
    if not touched:
        return []
    table = read_table(spark, inner)
    old = None if table is None else table.filter(F.col(BUCKET).isin(touched))
    # As many tasks as the rows ask for, so that none has to put more on disk than it was given.
    tasks = min(n, buckets_for(spark, new.count() + (0 if old is None else old.count())))
    if whole_rows:
        both = new if old is None else old.select(*new.columns).unionByName(new)
        merged = merge(None, both.repartition(tasks, BUCKET))
    else:
        merged = merge(None if old is None else old.drop(BUCKET), new.drop(BUCKET))
        merged = merged.withColumn(BUCKET, bucket_of([F.col(k) for k in keys], n)).repartition(tasks, BUCKET)
    # Stored first, as a table cannot replace what it is read from; a partition's rows lie together there.
    result = stage(merged, f"{work}-merged")
    writer = result.write.mode("overwrite").options(partitionOverwriteMode="dynamic", compression=COMPRESSION)
    writer.partitionBy(BUCKET).parquet(inner)
    # Partitions that have no row any more are not replaced by that.
    left = {r[0] for r in result.select(BUCKET).distinct().collect()}
    for bucket in set(touched) - left:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{inner}/{BUCKET}={bucket}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return touched


def add_to_diff_log(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Add the rows that the log does not have yet."""
    rows = new.select(*columns(ASSET_DIFF))
    keys = ["subject_id", "modality"]

    # Equal rows are in one partition.
    return upsert(spark, path, rows, keys, [F.col(k) for k in keys], lambda _, both: both.dropDuplicates(), buckets, True)


def update_states(
    spark: SparkSession, path: str, events: DataFrame, key: str, order: Sequence[str],
    keep_first: Sequence[str] = ("started_at", "worker_pid"), cleared: str = "cleared", buckets: int = BUCKETS,
) -> list[int]:
    """Merge updates into the states of their keys, in the order of arrival: what an update tells replaces what is
    stored, but for ``keep_first``, and attributes that its column ``cleared`` names become null."""
    def merge(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        state = merged_state(fresh, key, order, keep_first, cleared)
        if old is None:
            return state
        gone = F.flatten(F.collect_set(cleared)) if cleared in fresh.columns else F.array().cast("array<string>")
        named = fresh.groupBy(F.col(key).alias("_key")).agg(gone.alias("_gone"))
        told = state.withColumnsRenamed({c: f"_{c}" for c in state.columns if c != key})
        both = old.join(told.withColumnRenamed(key, "_id"), old[key].eqNullSafe(F.col("_id")), "full_outer")
        both = both.join(named, F.coalesce(F.col("_id"), F.lit("")).eqNullSafe(F.coalesce(F.col("_key"), F.lit(""))) & F.col(f"_{order[0]}").isNotNull(), "left")

        def value(c: str) -> Column:
            stored, mine = F.col(c), F.col(f"_{c}")
            if c in keep_first:
                return F.coalesce(stored, mine).alias(c)
            emptied = F.coalesce(F.array_contains("_gone", c), F.lit(False))
            return F.when(emptied, mine).otherwise(F.coalesce(mine, stored)).alias(c)

        id_column = F.coalesce(old[key], F.col("_id")).alias(key)
        return both.select(id_column, *[value(c) for c in state.columns if c != key])

    return upsert(spark, path, events, [key], [F.col(key)], merge, buckets)


def update_participants(spark: SparkSession, path: str, series: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Bring the subjects of a series table into the stored participants."""
    known = series.select("subject_id", "center").distinct()
    return upsert(
        spark, path, known, ["participant_id"], [F.concat(F.lit("sub-"), "subject_id")], participants_upsert, buckets
    )
