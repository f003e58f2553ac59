"""Alignment of the tokens of two tokenizers over the same text.

The ids of a slice of documents are two list columns. They are flattened with the index of their document, the
bytes of their tokens are summed within each document, and a hash join on (document, end) brings the two sides
together: ends that both have cut the text into groups, and every end of either side closes one stretch that
exactly one token of each side covers, a link. Linked pairs of ids are counted per document by ``group_by``,
partial counts of blocks are merged by Spark, and the corpus-wide counts return to the blocks (``blocks``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm import blocks
from scanloom.llm.common import texts_of
from scanloom.llm.tokens import PIECES, RANKS, piece_encoder, rank_encoder, vocabulary_path
from scanloom.operators.staging import stage

#: Bits of an end within its document, in the key of the join.
END_BITS = 40
#: Bits of the second id in a pair of ids.
ID_BITS = 16

FACTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
DECIMALS = pa.array([str(i) for i in range(1 << ID_BITS)], pa.large_string())


@lru_cache(maxsize=1)
def _tables(ranks: str, pieces: str) -> tuple[list[bytes], list[bytes], pa.Array, pa.Array]:
    """The bytes of every id of both sides, and how many they are."""
    a, b = rank_encoder(ranks).token_bytes(), piece_encoder(pieces).token_bytes()
    return a, b, pa.array(map(len, a), pa.int64()), pa.array(map(len, b), pa.int64())


def encoded(texts: list[str | None], ranks: str, pieces: str) -> tuple[pa.ListArray, pa.ListArray]:
    """The ids of both sides; none where either side's bytes are not those of a space and the text."""
    bytes_a, bytes_b, _, _ = _tables(ranks, pieces)
    known = [t or "" for t in texts]
    ids_a = rank_encoder(ranks).encode([" " + t for t in known])
    ids_b = piece_encoder(pieces).encode(known)
    for at, text in enumerate(known):
        whole = b" " + text.encode("utf-8", "surrogatepass")
        if not text or any(
            b"".join(map(side.__getitem__, ids[at])) != whole for side, ids in ((bytes_a, ids_a), (bytes_b, ids_b))
        ):
            ids_a[at], ids_b[at] = [], []
    return pa.array(ids_a, pa.large_list(pa.int64())), pa.array(ids_b, pa.large_list(pa.int64()))


def ends_of(ids: pa.Array, widths: pa.Array, name: str) -> pa.Table:
    """One row per token: its id and a key of its document and the byte at which it ends there."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(pc.take(widths, flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running])
    base = pc.take(before, pc.cast(ids.offsets[:-1], pa.int64()))
    ends = pc.subtract(running, pc.take(base, parents))
    key = pc.bit_wise_or(pc.shift_left(pc.cast(parents, pa.int64()), END_BITS), ends)
    return pa.table({"key": key, name: flat})


def linked(ids_a: pa.Array, ids_b: pa.Array, widths_a: pa.Array, widths_b: pa.Array) -> pa.Table:
    """Links in the order of the text: row (the document's place), a, b, and whether a group ends there."""
    left, right = ends_of(ids_a, widths_a, "a"), ends_of(ids_b, widths_b, "b")
    both = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
    a, b = both.column("a").combine_chunks(), both.column("b").combine_chunks()
    return pa.table({
        "row": pc.shift_right(both.column("key"), END_BITS),
        "a": pc.fill_null_backward(a), "b": pc.fill_null_backward(b),
        "new_a": pc.is_valid(a), "new_b": pc.is_valid(b),
        "closes": pc.and_(pc.is_valid(a), pc.is_valid(b)),
    })


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def written(links: pa.Table, ids_a: pa.Array, ids_b: pa.Array, per_row: np.ndarray) -> list[str]:
    """The groups of every document as text: ids of a group by commas, sides by a bar, groups by semicolons."""
    closes = links.column("closes").to_numpy()
    sides = []
    for ids, new in ((ids_a, "new_a"), (ids_b, "new_b")):
        upto = np.cumsum(links.column(new).to_numpy())[closes]
        text = pc.take(DECIMALS, pc.list_flatten(ids))
        sides.append(pc.binary_join(_lists(np.concatenate([[0], upto]), text), pa.scalar(",", pa.large_string())))
    groups = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string()))
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    return pc.binary_join(_lists(offsets, groups), pa.scalar(";", pa.large_string())).to_pylist()


def _per_row(rows: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """How many of ``rows`` each document has."""
    counted = pa.table({"row": rows}).group_by("row", use_threads=False).aggregate([([], "count_all")])
    out = np.zeros(n, np.int64)
    out[counted.column("row").to_numpy()] = counted.column("count_all").to_numpy()
    return out


def _facts(texts: list[str | None], ranks: str, pieces: str) -> tuple[dict, pa.Table]:
    """Numbers and group texts of a slice's documents, and its links per (row, pair) with their times."""
    _, _, widths_a, widths_b = _tables(ranks, pieces)
    ids_a, ids_b = encoded(texts, ranks, pieces)
    links = linked(ids_a, ids_b, widths_a, widths_b)
    n = len(texts)
    n_groups = _per_row(links.filter(links.column("closes")).column("row"), n)
    pair = pc.bit_wise_or(pc.shift_left(links.column("a"), ID_BITS), links.column("b"))
    counted = (
        pa.table({"row": links.column("row"), "pair": pair})
        .group_by(["row", "pair"], use_threads=False).aggregate([([], "count_all")])
    )
    return {
        "n_a": pc.list_value_length(ids_a), "n_b": pc.list_value_length(ids_b),
        "n_groups": pa.array(n_groups), "n_links": pa.array(_per_row(links.column("row"), n)),
        "groups_sha256": pa.array([
            hashlib.sha256(groups.encode()).hexdigest() if groups else ""
            for groups in written(links, ids_a, ids_b, n_groups)
        ], pa.string()),
    }, counted


def gathered(
    docs: DataFrame, ranks: str | None = None, pieces: str | None = None, block_bytes: int = blocks.BLOCK_BYTES
) -> DataFrame:
    """The stored table of ``blocks``: facts of documents, and the linked pairs of ids of every block with the
    number of its documents that hold them."""
    ranks, pieces = ranks or vocabulary_path(RANKS), pieces or vocabulary_path(PIECES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = TaskContext.get().partitionId() * blocks.PARTITION_STRIDE
        facts: list[dict] = []
        found: list[pa.Table] = []
        size = rows = 0

        def stored() -> Iterator[dict]:
            all_pairs = pa.concat_tables(found).combine_chunks()
            coded = pc.dictionary_encode(all_pairs.column("pair").combine_chunks())
            place = coded.indices.to_numpy()
            documents = {c: pa.concat_arrays([f[c] for f in facts]) for c in facts[0]}
            keys = all_pairs.column("row").to_numpy() << 32 | place
            order = np.argsort(keys)
            yield documents | {"block": [block] * rows} | blocks.stepped(
                keys[order], all_pairs.column("count_all").to_numpy()[order], rows
            )
            partial = pa.table({"place": coded.indices}).group_by("place", use_threads=False).aggregate([([], "count_all")])
            places = partial.column("place").combine_chunks()
            yield from blocks.dictionary_rows(
                block, pc.take(coded.dictionary, places), places.to_numpy(), partial.column("count_all").to_numpy()
            )

        for piece in blocks.slices(batches):
            texts = piece.column("text").to_pylist()
            told, counted = _facts(texts, ranks, pieces)
            facts.append({"doc_id": piece.column("doc_id")} | told)
            found.append(counted.set_column(0, "row", pc.add(counted.column("row"), rows)))
            rows += len(texts)
            size += piece.column("text").nbytes
            if size >= block_bytes:
                yield from stored()
                facts, found, size, rows, block = [], [], 0, 0, block + 1
        if rows:
            yield from stored()

    schema = f"{FACTS}, {blocks.DOCUMENT}, {blocks.DICTIONARY.format(key='long')}"
    return stage(blocks.map_rows(texts_of(docs), work, schema), "aligned")


def pair_counts(stored: DataFrame) -> DataFrame:
    """All linked pairs: a, b, n_docs (documents that hold the pair linked), best (no pair of a has more)."""
    counted = blocks.totals(stored).select(
        F.shiftright("key", ID_BITS).alias("a"), F.col("key").bitwiseAND((1 << ID_BITS) - 1).alias("b"),
        F.col("total").alias("n_docs"), "key",
    )
    most = counted.groupBy("a").agg(F.max("n_docs").alias("_most"))
    return counted.join(most, "a").withColumn("best", F.col("n_docs") == F.col("_most")).drop("_most")


def digest(docs: DataFrame, ranks: str | None = None, pieces: str | None = None, block_bytes: int = blocks.BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many
    documents as any pair of its first id), count_sum (documents of the pair, over the links), groups_sha256.

    A text that is null, empty or does not come back from either side's bytes has zeros and an empty checksum.
    Texts of any length are worked on whole. Repeated rows are documents of their own, a null doc_id stays null,
    other columns are ignored, and an empty table gives no rows.
    """
    stored = gathered(docs, ranks, pieces, block_bytes)
    numbers = pair_counts(stored).select("key", F.col("n_docs").alias("total"), "best")

    def summed(rows: pa.Table, told: pa.Table) -> pa.Table:
        total, best = blocks.looked_up(told, "total"), blocks.looked_up(told, "best")
        n_best, count_sum = [], []
        for steps, times in zip(rows.column("steps").to_pylist(), rows.column("times").to_pylist()):
            places, n = blocks.places_of(steps), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int(n[best[places]].sum()))
            count_sum.append(int((n * total[places]).sum()))
        made = rows.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64())
        )
        return made.select([f.split()[0] for f in RESULT.split(", ")])

    return blocks.returned(blocks.documents(stored), stored, numbers, summed, RESULT)


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """The groups themselves, in order: doc_id, place (from 0), a_ids and b_ids of the group.

    Documents without tokens have no group; see ``digest`` for the other cases.
    """
    ranks, pieces = ranks or vocabulary_path(RANKS), pieces or vocabulary_path(PIECES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        _, _, widths_a, widths_b = _tables(ranks, pieces)
        for piece in blocks.slices(batches):
            ids_a, ids_b = encoded(piece.column("text").to_pylist(), ranks, pieces)
            links = linked(ids_a, ids_b, widths_a, widths_b)
            closes = links.column("closes").to_numpy()
            if not closes.any():
                continue
            rows = links.column("row").to_numpy()[closes]
            at = np.arange(len(rows))
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            sides = {
                f"{side}_ids": _lists(
                    np.concatenate([[0], np.cumsum(links.column(f"new_{side}").to_numpy())[closes]]), pc.list_flatten(ids)
                )
                for side, ids in (("a", ids_a), ("b", ids_b))
            }
            place = at - np.repeat(starts, np.diff(np.append(starts, len(rows))))
            yield {"doc_id": pc.take(piece.column("doc_id"), pa.array(rows)), "place": place} | sides

    return blocks.map_rows(texts_of(docs), work, "doc_id long, place long, a_ids array<int>, b_ids array<int>")
