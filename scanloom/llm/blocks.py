"""Numbers about keys, gathered over all data and sent back to where the keys stand.

A task works through its documents in blocks. For a document it keeps its keys as rising places in the block's
dictionary, with the times of each; for the block one row per distinct key, with a partial number. Both kinds of
rows go into one stored table, so that texts are worked on once. The partial numbers are summed by key, the
sums are joined back to the dictionaries, and every block meets its own in one task, which is as large as a block
whatever the corpus. A key that all documents hold has one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text in a block, and in the slices in which a block is worked on.
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: Rows of a dictionary that are handed over at once.
LISTED_ROWS = 1 << 15
#: Room in the numbers of blocks for those of one partition.
PARTITION_STRIDE = 1 << 32

DOCUMENT = "block long, steps binary, times binary"
DICTIONARY = "key {key}, place int, n long"


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` where ``work`` yields dicts of columns; columns that it leaves out are null."""
    schema = schema_of(ddl)
    made = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(batches):
            n = len(next(iter(out.values())))
            columns = [
                pa.nulls(n, f.type) if f.name not in out
                else out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type)
                for f in made
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=made)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes in ``column``; a longer row stands alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for at, n in enumerate(lengths.tolist()):
            if at > start and held + n > size:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def stepped(keys: np.ndarray, times: np.ndarray, n_rows: int) -> dict[str, pa.Array]:
    """Binary columns ``steps`` and ``times`` of ``n_rows`` documents, from rising keys ``row << 32 | place`` and times."""
    rows, places = keys >> 32, keys & 0xFFFFFFFF
    ends = np.searchsorted(rows, np.arange(n_rows), "right")
    steps = np.diff(places, prepend=0)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    steps[first] = places[first]
    offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64))

    def packed(values: np.ndarray) -> pa.Array:
        data = pa.py_buffer(np.ascontiguousarray(values, "<u4"))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_rows, [None, offsets, data]).cast(pa.binary())

    return {"steps": packed(steps), "times": packed(times)}


def dictionary_rows(block: int, keys: pa.Array, places: np.ndarray, n: np.ndarray) -> Iterator[dict]:
    """The rows of a block's dictionary, some thousands at a time."""
    for at in range(0, len(keys), LISTED_ROWS):
        part = keys[at : at + LISTED_ROWS]
        yield {"block": [block] * len(part), "key": part, "place": places[at : at + len(part)], "n": n[at : at + len(part)]}


def places_of(steps: bytes) -> np.ndarray:
    return np.frombuffer(steps, "<u4").cumsum(dtype=np.int64)


def documents(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("place").isNull()).drop("key", "place", "n")


def dictionary(stored: DataFrame) -> DataFrame:
    return stored.filter(F.col("place").isNotNull()).select("block", "key", "place", "n")


def totals(stored: DataFrame) -> DataFrame:
    """key and the sum of its partial numbers, ``total``."""
    return dictionary(stored).groupBy("key").agg(F.sum("n").alias("total"))


def returned(
    docs: DataFrame, stored: DataFrame, numbers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], ddl: str
) -> DataFrame:
    """Per block, ``work`` on its ``docs`` and the places of its stored dictionary with the ``numbers`` of their keys."""
    told = dictionary(stored).select(F.col("block").alias("of_block"), "place", "key").join(numbers, "key").drop("key")
    return docs.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(work, schema_of(ddl))


def looked_up(told: pa.Table, column: str) -> np.ndarray:
    """Values of ``column`` by place."""
    places, values = told.column("place").to_numpy(), told.column(column).to_numpy()
    out = np.zeros(int(places.max(initial=-1)) + 1, values.dtype)
    out[places] = values
    return out
