"""Token counts from the pieces of distinct pre-tokens.

A pre-token here is a space-delimited piece of text, over whose edges no merge goes (``tokens``). Documents
are gathered in blocks of about ``BLOCK_BYTES``. A block lists its distinct pre-tokens once, and each document
its frequencies as positions in that list. The lists are cut by a hash of the pre-token and dealt by it, so that
each distinct pre-token meets itself in one task and is given to the library once; the numbers of pieces return
to their block, where they are joined to the frequencies and summed. No ids are kept, and what is shuffled
grows with the distinct pre-tokens of blocks rather than with those of documents.

Blocks are made twice, once for the lists and once for the frequencies, instead of being stored: both need
an input whose partitions have a fixed row order, such as a stored table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import by_column, map_columns, partitions, texts_of
from scanloom.llm.tokens import encoder, pieces_of, vocabulary_path

BLOCK_BYTES = 24 << 20
LIMIT = 1024
PARTITION_STRIDE = 1 << 32
#: Parts of a block's list for each shuffle partition.
PARTS = 4
#: A byte that UTF-8 never has, between the pre-tokens of a list.
BETWEEN = b"\xff"

#: doc_id travels as text: pandas would make floats of integers beside nulls.
FREQUENCIES = "block long, doc_id string, n_bytes long, steps binary, times binary"
LISTS = "block long, part int, steps binary, pieces binary"
NUMBERS = "block long, steps binary, numbers binary"


def frequencies(text: str) -> Counter:
    """How often each pre-token stands in a text."""
    parts = pieces_of(text)
    found = Counter(parts[1:])
    out = Counter({" " + p: n for p, n in found.items()})
    if parts[0]:
        out[parts[0]] += 1
    return out


def steps_of(places: np.ndarray) -> bytes:
    """Rising places as differences, small numbers which compress well."""
    return np.diff(places, prepend=0).astype(np.uint32).tobytes()


def places_of(steps: bytes) -> np.ndarray:
    return np.frombuffer(steps, np.uint32).cumsum(dtype=np.int64)


def blocks(docs: DataFrame, parts: int, lists: bool, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' frequencies, or the blocks' lists of pre-tokens in ``parts`` parts."""

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        block = TaskContext.get().partitionId() * PARTITION_STRIDE
        place: dict[str, int] = {}
        size = 0

        def listed() -> dict:
            found: dict[int, tuple[list, list]] = {}
            for at, piece in enumerate(place):
                written = piece.encode("utf-8", "surrogatepass")
                places, pieces = found.setdefault(zlib.crc32(written) % parts, ([], []))
                places.append(at)
                pieces.append(written)
            rows = [(block, part, steps_of(np.array(a)), BETWEEN.join(p)) for part, (a, p) in found.items()]
            return by_column(rows, LISTS)

        for batch in slices:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                text = text or ""
                n_bytes = len(text.encode("utf-8", "surrogatepass"))
                if size and size + n_bytes > block_bytes:
                    if lists:
                        yield listed()
                    place, size, block = {}, 0, block + 1
                own = frequencies(text)
                at = np.fromiter((place.setdefault(p, len(place)) for p in own), np.int64, len(own))
                size += n_bytes
                if not lists:
                    times = np.fromiter(own.values(), np.uint32, len(own))
                    order = np.argsort(at)
                    found.append((block, None if doc_id is None else str(doc_id), n_bytes, steps_of(at[order]), times[order].tobytes()))
            if found:
                yield by_column(found, FREQUENCIES)
        if lists and place:
            yield listed()

    return map_columns(texts_of(docs), work, LISTS if lists else FREQUENCIES)


def _numbers(listed: DataFrame, path: str) -> DataFrame:
    """The library's number of pieces for every pre-token of every list; each distinct one is counted once.

    Equal pre-tokens are in equal parts, hence in one task, which remembers its own.
    """

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        ids_of, known = encoder(path).piece, {}
        for rows in slices:
            out = []
            for block, steps, joined in zip(rows["block"], rows["steps"], rows["pieces"]):
                pieces = joined.split(BETWEEN)
                for piece in pieces:
                    if piece not in known:
                        known[piece] = len(ids_of(piece.decode("utf-8", "surrogatepass"))) // 4
                numbers = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
                kind = np.uint8 if numbers.max() < 256 else np.uint32
                out.append((block, steps, numbers.astype(kind).tobytes()))
            yield by_column(out, NUMBERS)

    return map_columns(listed.repartition("part").select("block", "steps", "pieces"), work, NUMBERS, rows=16)


def count(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit``).

    Numbers are the library's own for the whole text, special strings handled as it does by default. A null
    text counts as empty and has no token; a null doc_id stays null; repeated rows stay repeated; other
    columns are ignored.
    """
    parts = PARTS * partitions(docs.sparkSession)
    own = blocks(docs, parts, lists=False, block_bytes=block_bytes)
    numbers = _numbers(blocks(docs, parts, lists=True, block_bytes=block_bytes), vocabulary or vocabulary_path())

    def total(docs: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        places = [places_of(steps) for steps in numbers["steps"]]
        n = np.zeros(1 + max((p[-1] for p in places), default=-1), np.int64)
        for at, found in zip(places, numbers["numbers"]):
            n[at] = np.frombuffer(found, np.uint8 if len(found) == len(at) else np.uint32)
        tokens = [
            int((n[places_of(steps)] * np.frombuffer(times, np.uint32)).sum())
            for steps, times in zip(docs["steps"], docs["times"])
        ]
        return pd.DataFrame({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": tokens})

    summed = own.groupBy("block").cogroup(numbers.groupBy("block")).applyInPandas(
        total, "doc_id string, n_bytes long, n_tokens long"
    )
    return summed.withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "over_limit": F.col("n_tokens") > limit}
    )
