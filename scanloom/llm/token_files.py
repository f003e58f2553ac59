"""Token ids in length-delimited binary records with a separate offset index.

Format: a file is a run of records. A record is an 8-byte little-endian length, the masked checksum of those
8 bytes, the payload, and the masked checksum of the payload. Checksums are CRC-32 (zlib), rotated right by 15
bits plus a constant, as 4 bytes. A payload is one byte (1 if there is a doc_id), one byte with the bytes of an
id (2 for a vocabulary of at most 65,536, else 4), the doc_id as 8 bytes, and the ids, all little-endian. Files hold documents in ascending doc_id order, and so
do the files of the parts in turn. The index, Parquet beside the files, names file, offset, bytes and first id of
every record, so readers can take records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.llm.common import by_column, map_columns, partitions, texts_of
from scanloom.llm.tokens import ID, encoder, vocabulary_path

END_ID = 0
FILE_BYTES = 64 << 20
#: Fixed value: the constant that masks a stored checksum.
MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
KEY = struct.Struct("<BBq")
TAIL = struct.Struct("<I")

INDEX_SCHEMA = (
    "part int, number long, file string, offset long, bytes long, doc_id long, first long, n_tokens long"
)
RECORD_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one record; a ValueError if any byte of it has changed."""
    length, check = HEAD.unpack_from(record)
    payload = record[HEAD.size : -TAIL.size]
    if masked(record[:8]) != check or length != len(payload) or masked(payload) != TAIL.unpack(record[-4:])[0]:
        raise ValueError("damaged record")
    return payload


def record_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """The record of 32-bit ids, written with ``width`` bytes each."""
    narrow = np.frombuffer(ids, ID).astype(f"<u{width}").tobytes()
    return frame(KEY.pack(doc_id is not None, width, doc_id or 0) + narrow)


def parse(record: bytes) -> tuple[int | None, bytes]:
    """doc_id and 32-bit ids of one whole record."""
    payload = unframe(record)
    known, width, doc_id = KEY.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=KEY.size).astype(ID).tobytes()


def _filesystem(folder: str):
    """The store that ``folder`` names (file, hdfs, s3, gs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode, write the record files and the index below ``folder``, and return the index.

    Order is by doc_id, nulls first, then by a hash of the text; rows that tie on both are alike. A null or
    empty text is its end id alone. Rows are dealt by ranges of that order; a last key from the row's place in the
    input lets the splitters cut a doc_id that very many rows share. File names carry the task attempt, and
    the index, which Spark commits, names only files of the attempts that counted. ``folder`` must be shared.
    """
    path = vocabulary or vocabulary_path()

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        context = TaskContext.get()
        part = context.partitionId()
        store, root = _filesystem(folder)
        end = np.array([END_ID], ID).tobytes()
        width = 2 if encoder(path).library.get_vocab_size() <= 1 << 16 else 4
        out, file, at, files, number, first = None, "", 0, 0, 0, 0
        for piece in slices:
            rows = []
            for doc_id, ids in zip(piece["doc_id"], encoder(path).encode([t or "" for t in piece["text"]])):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    file = f"part-{part:06d}-{context.taskAttemptId()}-{files:04d}.tokens"
                    out, at, files = store.open_output_stream(f"{root}/{file}"), 0, files + 1
                record = record_of(doc_id, ids + end, width)
                out.write(record)
                n = len(ids) // ID.itemsize + 1
                rows.append((part, number, file, at, len(record), doc_id, first, n))
                at, number, first = at + len(record), number + 1, first + n
            yield by_column(rows, INDEX_SCHEMA)
        if out is not None:
            out.close()

    store, root = _filesystem(folder)
    store.create_dir(root)
    spark = docs.sparkSession
    keyed = texts_of(docs).select(
        "*", F.xxhash64("text").alias("_key"), F.monotonically_increasing_id().alias("_tie")
    )
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "_key", "_tie").sortWithinPartitions(
        "doc_id", "_key"
    )
    map_columns(ordered.select("doc_id", "text"), work, INDEX_SCHEMA).write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index, with ``start``: ids of all records before."""
    schema = spark.createDataFrame([], INDEX_SCHEMA).schema
    rows = spark.read.schema(schema).parquet(f"{folder}/index")
    # One row per part, so as many as there were shuffle partitions.
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("first") + F.col("_before")).drop("_before")


def read(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """Records read back and verified: doc_id, start, n_tokens, ids. With ``seed``, in a shuffled order."""
    wanted = index(spark, folder).select("file", "offset", "bytes", "start")
    if seed is not None:
        wanted = wanted.repartition(F.xxhash64("file", "offset", F.lit(seed))).sortWithinPartitions(
            F.xxhash64("file", "offset", F.lit(seed))
        )

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        store, root = _filesystem(folder)
        name, source = None, None
        for piece in slices:
            rows = []
            for file, offset, size, start in zip(*(piece[c] for c in ("file", "offset", "bytes", "start"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{root}/{file}")
                doc_id, ids = parse(source.read_at(size, offset))
                rows.append((doc_id, start, len(ids) // ID.itemsize, ids))
            yield by_column(rows, RECORD_SCHEMA)
        if source is not None:
            source.close()

    return map_columns(wanted, work, RECORD_SCHEMA)


def new_folder(shared: str) -> str:
    return f"{shared}/token-files-{uuid.uuid4().hex}"
