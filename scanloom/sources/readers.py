"""Readers of the stored tables and of the text formats they are exchanged in."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions.text import blank, relative_to, strip, subject_label
from scanloom.operators.review import last_per_key
from scanloom.operators.staging import stage
from scanloom.schemas import INSTANCES, SELECTION, SERIES, columns
from scanloom.sources import splitting


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """relpath, length and mtime of all files below ``root``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    start = F.locate(base, F.col("path")) + F.lit(len(base))
    return files.select(
        F.substring(F.col("path"), start, F.length("path")).alias("relpath"),
        "length",
        F.col("modificationTime").alias("mtime"),
    )


#: Files up to this size are digested as one value, larger ones in blocks.
WHOLE_FILE = 256 << 20
DIGEST_BLOCK = 8 << 20


def fixity(spark: SparkSession, root: str, whole_file: int = WHOLE_FILE) -> DataFrame:
    """path, length and SHA-256 of every file below ``root``, of any size.

    Files of more than ``whole_file`` bytes are read block by block in a task each, so no value holds a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = files.filter(F.col("length") <= whole_file).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole_file).select("path", "length")
    block = DIGEST_BLOCK

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
                total = hashlib.sha256()
                with store.open_input_stream(place) as source:
                    while data := source.read(block):
                        total.update(data)
                sums.append(total.hexdigest())
            yield batch.append_column("sha256", pa.array(sums, pa.string()))

    # Dealt by path, so that a few large files are not one task's.
    dealt = large.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return small.unionByName(dealt.mapInArrow(digest, "path string, length long, sha256 string"))


def walked_listing(spark: SparkSession, root: str) -> DataFrame:
    """As ``file_listing``, with the tree expanded level by level in tasks instead of on the driver.

    A table of folders is listed by tasks into files and the folders of the next level, until there are none. The
    driver only learns whether there are more, so the number of files does not matter to it. Links to folders are
    not followed; a folder that cannot be read stops the walk. ``root`` is a local path or a URI that pyarrow opens.
    """
    made = "path string, folder boolean, length long, mtime timestamp"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime
        import os

        from pyarrow import fs

        kinds = pa.schema([
            ("path", pa.string()), ("folder", pa.bool_()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC")),
        ])

        def entries(place: str) -> Iterator[tuple]:
            if place.startswith("file:") or "://" not in place:
                with os.scandir(place.removeprefix("file://").removeprefix("file:")) as found:
                    for entry in found:
                        if entry.is_dir(follow_symlinks=False) or entry.is_file():
                            fact = entry.stat()
                            yield entry.path, entry.is_dir(follow_symlinks=False), fact.st_size, fact.st_mtime_ns // 1000
                return
            store, path = fs.FileSystem.from_uri(place.replace("s3a://", "s3://", 1))
            start = place.replace("s3a://", "s3://", 1).removesuffix(path)
            for fact in store.get_file_info(fs.FileSelector(path)):
                yield start + fact.path, fact.type == fs.FileType.Directory, fact.size or 0, (fact.mtime_ns or 0) // 1000

        for batch in batches:
            for place in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for path, folder, length, micros in entries(place):
                    when = datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=micros)
                    rows.append((path, folder, 0 if folder else length, when))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = root.rstrip("/")
    frontier = spark.createDataFrame([(base,)], "path string")
    levels: list[DataFrame] = []
    while not levels or not frontier.isEmpty():
        level = stage(frontier.repartition(n, "path").mapInArrow(listed, made), "listing")
        levels.append(level.filter(~F.col("folder")))
        frontier = level.filter("folder").select("path")
    local = base.removeprefix("file://").removeprefix("file:")
    top = base.replace("s3a://", "s3://", 1) if "://" in base and not base.startswith("file:") else local
    files = reduce(DataFrame.unionByName, levels)
    return files.select(relative_to(F.col("path"), top).alias("relpath"), "length", "mtime")


def read_instances(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).schema(INSTANCES).load(path)


_TSV = {
    "sep": "\t", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def read_tsv(
    spark: SparkSession, path: str, position: str | None = None, multi_line: bool = True, split: bool | None = None
) -> DataFrame:
    """A headed TSV as text columns, blanks as empty strings, doubled quotes understood.

    ``position`` names a column that orders rows by file name, then line. Quoted cells may hold line breaks; a
    file larger than one task's share is then cut between its records (``splitting``), which ``split`` asks for or
    forbids whatever the size. ``multi_line=False`` reads line by line, for tables without such cells.
    """
    raw = spark.read.options(**_TSV, header=True, multiLine=multi_line).csv(path)
    cells = [blank(F.col(f"`{c}`")).alias(c) for c in raw.columns]
    if multi_line and (splitting.worth_splitting(spark, path) if split is None else split):
        records = splitting.tsv_records(spark, path)
        # The parser gets plain names; a name of the header may not be one of a schema.
        names = [f"_c{i}" for i in range(len(raw.columns))]
        parsed = F.from_csv("value", ", ".join(f"{n} STRING" for n in names), _TSV)
        rows = records.withColumn("_cells", parsed)
        cells = [blank(F.col("_cells")[n]).alias(c) for n, c in zip(names, raw.columns)]
        place = F.struct(F.col("_file").alias("file"), F.struct("_block", "_at").alias("line"))
        return rows.select(*cells, *([place.alias(position)] if position else []))
    if not position:
        return raw.select(*cells)
    # Ids grow along the partitions of a scan, which keeps the order of lines within one file.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return raw.select(*cells, place.alias(position))


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """A selection TSV; absent columns are empty, a blank score is 0."""
    cells = read_tsv(spark, path)

    def cell(name: str) -> Column:
        value = F.col(name) if name in cells.columns else F.lit("")
        if name == "score":
            value = F.coalesce(F.nullif(value, F.lit("")).try_cast("double"), F.lit(0.0))
        return value.alias(name)

    return cells.select(*[cell(c) for c in columns(SELECTION)])


def read_series_json(spark: SparkSession, path: str, split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON arrays of series as (series, source files).

    A file larger than one task's share is cut between its objects (``splitting``), which ``split`` asks for or
    forbids whatever the size.
    """
    schema = f"{SERIES}, source_relpaths ARRAY<STRING>"
    if splitting.worth_splitting(spark, path) if split is None else split:
        rows = splitting.json_elements(spark, path).select(F.from_json("value", schema).alias("_row")).select("_row.*")
    else:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    keys = ["center", "subject_id", "study_uid_hash", "series_uid_hash"]
    sources = rows.select(*keys, F.explode("source_relpaths").alias("source_relpath"))
    return rows.drop("source_relpaths"), sources


def read_state_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file; files that hold anything else are skipped."""
    rows = (
        spark.read.schema(f"{schema}, _broken STRING")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_broken")
        .json(path)
    )
    return rows.filter(F.col("_broken").isNull()).drop("_broken")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Validator reports, one whole file per row under ``json``; one null where there is no such file or folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        return spark.createDataFrame([(None,)], "json string")
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


RATE_NAMES = [f"{c}_per_second" for c in ("disk_write_bytes", "network_sent_bytes", "nfs_write_bytes")]


def read_latest_rates(spark: SparkSession, path: str, names: list[str] = RATE_NAMES) -> DataFrame:
    """The named cells of a resource log's last row as numbers; null where a cell is absent or none.

    One row, or none if the log has no rows. Of several files the last by name counts.
    """
    log = read_tsv(spark, path, "_position")
    last = log.orderBy(F.desc("_position")).limit(1)
    cells = [F.col(f"`{n}`") if n in log.columns else F.lit(None).cast("string") for n in names]
    return last.select(*[c.try_cast("double").alias(n) for c, n in zip(cells, names)])


def read_subject_list(spark: SparkSession, path: str) -> DataFrame:
    """First tab-separated field of every line; blanks, comments and the header are skipped."""
    first = strip(F.substring_index(F.replace("value", F.lit("﻿"), F.lit("")), "\t", 1))
    names = spark.read.text(path).select(first.alias("name"))
    wanted = names.filter(
        (F.col("name") != "")
        & ~F.col("name").startswith("#")
        & (F.lower("name") != "participant_id")
    )
    return wanted.select(subject_label(F.col("name")).alias("subject_id")).distinct()


def read_dataset_table(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A participants or scans TSV: unknown columns are kept, rows without a key dropped, and of rows
    with one key the last counts."""
    rows = read_tsv(spark, path, "_position").filter(F.col(key) != "")
    return last_per_key(rows, [key], ["_position"]).select(*[c for c in rows.columns if c != "_position"])


