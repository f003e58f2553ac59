"""Tables written once and read several times, kept where every executor can reach them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Staged tables are written and read a few times over a shared store: smaller counts for more than quicker.
COMPRESSION = "zstd"
#: Columns with hardly two rows alike in a file: Parquet's search for repeated values costs much there and saves nothing.
UNLIKE = ("relpath", "subject_id", "study_uid_hash", "series_uid_hash", "output_basename")
_local: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh temporary one only for a local session."""
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    application = context.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _local[application], ignore_errors=True)
    return _local[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which ``release`` removes."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_tables: dict[str, str] = {}


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows a bucket is made for: the sort of that many wide rows (about 100 MB) stays in a task's memory.
BUCKET_ROWS = 125_000


def buckets_for(spark: SparkSession, rows: int) -> int:
    """How many buckets a table of ``rows`` wide rows is dealt into: their number grows with the table, not their size."""
    return max(bucket_count(spark), -(-rows // BUCKET_ROWS))


def stage_bucketed(df: DataFrame, label: str, keys: list[str], buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """As ``stage``, dealt into buckets by ``keys``: joins and groups on them, or on more, need no exchange of it.

    ``dealt`` says that the rows lie like that already and need not move; where they do not, buckets only get more files.

    The catalog knows the table by a name of its own for as long as the application; ``release`` drops it.
    Rows of one key share a bucket, so this is for keys that none holds a large share of.
    """
    spark = df.sparkSession
    n = buckets or bucket_count(spark)
    path = scratch_path(spark, label)
    name = f"staged_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, *keys)
    # A task holds one bucket, so it writes rows as they come; by default Spark would sort each task's rows by bucket.
    with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "4"):
        _writer(rows).bucketBy(n, *keys).option("path", path).saveAsTable(name)
    _tables[path] = name
    return spark.table(name)


def _writer(df: DataFrame) -> DataFrameWriter:
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in UNLIKE if c in df.columns}
    return df.write.options(compression=COMPRESSION, **plain)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession, label: str = "") -> int:
    """Delete what this application has staged under names that start with ``label``; how many places.

    Tables read from them can no longer be used. A folder of a local session goes at its end anyway.
    """
    made = _made.get(spark.sparkContext.applicationId, [])
    paths = [p for p in made if p.rpartition("/")[2].startswith(label)]
    for path in paths:
        made.remove(path)
        if name := _tables.pop(path, None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet and return the table read back.

    Cuts the lineage without tying the data to an executor, and gives later readers column
    pruning, pushed filters and true sizes for the choice of join.
    """
    path = scratch_path(df.sparkSession, label)
    _writer(df).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
