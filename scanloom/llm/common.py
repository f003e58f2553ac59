"""Small pieces that several text operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import scanloom

#: The white space that the operators' contracts name, [\\x20\\x09-\\x0D].
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
    "array<string>": pa.list_(pa.string()),
    "array<struct<kind:string,start:int,end:int,disguised:boolean>>": pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]
    )),
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for working columns that cannot meet a column of the input."""
    taken = {c.lower() for c in columns}
    return [n if n.lower() not in taken else f"{n}_{uuid.uuid4().hex[:8]}" for n in names]


def without_spaces(text: Column) -> Column:
    """The text with every SPACES character deleted. Byte-wise replacement, cheaper than a pattern."""
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else: ``lower`` where all is ASCII, character by character otherwise."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_columns(df: DataFrame, work, schema: str, rows: int = 256) -> DataFrame:
    """``mapInArrow`` over plain lists: ``work`` gets dicts of columns, ``rows`` rows each, and yields such dicts.

    Integers stay integers beside nulls, and only a slice of a batch is held as Python objects.
    """
    fields = [field.split() for field in schema.split(", ")]
    made = pa.schema([(name, ARROW[kind]) for name, kind in fields])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows).to_pydict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(slices(batches)):
            yield pa.RecordBatch.from_pydict(out, schema=made)

    return df.mapInArrow(run, schema)


def by_column(rows: list[tuple], schema: str) -> dict:
    """Rows as a dict of columns in the order of ``schema``."""
    names = [field.split()[0] for field in schema.split(", ")]
    return dict(zip(names, zip(*rows))) if rows else {name: [] for name in names}


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers of an application, which may not have it on their path."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        folder = tempfile.mkdtemp(prefix="spark-")  # of the driver; Spark copies the archive to executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = Path(scanloom.__file__).resolve().parent.parent
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/scanloom", "zip", root, "scanloom"))
        _shipped.add(application)
