"""Hierarchical packing into windows of several lengths.

Documents (with an end id) are routed to the smallest context tier that holds them; longer ones are cut into
full windows of the largest tier first, and their rest is routed. Tiers are packed from the longest: an item
opens a window and the gap behind it is filled from shorter tiers, with the longest item that fits, or else
with the front of one that does not, whose rest goes back to the tiers. So every window is full. What remains
at the end of a lot is cut into windows at powers of two. Windows are then dealt to step groups of about equal
token numbers, longest first to the lightest group.

A lot is a bounded run of tokens from one partition of the input: one pass, no shuffle, and a lost task
repeats only its own partition, with the same ids. That needs an input whose partitions have a fixed row
order, such as a stored table.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import by_column, map_columns, texts_of
from scanloom.llm.tokens import ID, encoder, vocabulary_path

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens held and packed together.
LOT_TOKENS = 1 << 21
#: Tokens that one training step takes.
STEP_TOKENS = 1 << 17
#: Room in the ids for so many sequences or groups of one partition.
PARTITION_STRIDE = 1 << 32

SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_group long, ids binary"
)


class Pool:
    """Rests waiting for a place, by tier; each is (length, document, start)."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tiers
        self.items: list[list[tuple[int, int, int]]] = [[] for _ in tiers]

    def add(self, length: int, doc: int, start: int) -> None:
        insort(self.items[bisect_left(self.tiers, length)], (length, doc, start))

    def longest(self, tier: int):
        return self.items[tier].pop() if self.items[tier] else None

    def filling(self, gap: int, below: int):
        """The longest item of a tier below ``below`` that fits ``gap``; else the shortest one, to be cut."""
        for tier in range(min(below - 1, bisect_left(self.tiers, gap)), -1, -1):
            at = bisect_right(self.items[tier], (gap, np.inf, 0)) - 1
            if at >= 0:
                return self.items[tier].pop(at)
        for tier in range(below):
            if self.items[tier]:
                return self.items[tier].pop(0)
        return None


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length). Each is full at a tier, but for the last few at lesser powers of two."""
    largest, pool, windows = tiers[-1], Pool(tiers), []
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= largest:
            windows.append([(doc, start, largest)])
            start += largest
        if n > start:
            pool.add(n - start, doc, start)
    for tier in range(len(tiers) - 1, -1, -1):
        size = tiers[tier]
        while (item := pool.longest(tier)) is not None:
            window, gap = [], size
            while item is not None:
                length, doc, start = item
                taken = min(length, gap)
                window.append((doc, start, taken))
                gap -= taken
                if taken < length:
                    pool.add(length - taken, doc, start + taken)
                if not gap:
                    break
                item = pool.filling(gap, tier) or pool.longest(tier)
            if not gap:
                windows.append(window)
            else:
                windows.extend(_at_powers(window))
    return windows


def _at_powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a window that could not be filled, in windows of falling powers of two."""
    left, out = sum(length for _, _, length in window), []
    pieces = window[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        part = []
        while size:
            doc, start, length = pieces.pop()
            taken = min(size, length)
            part.append((doc, start, taken))
            size -= taken
            if taken < length:
                pieces.append((doc, start + taken, length - taken))
        out.append(part)
    return out


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """Group of each window, so that groups have about ``step_tokens`` tokens and none much more than another."""
    heap = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, group = heapq.heappop(heap)
        out[at] = group
        heapq.heappush(heap, (held + sizes[at], group))
    return out


def pack(
    docs: DataFrame, tiers: tuple[int, ...] = TIERS, vocabulary: str | None = None,
    lot_tokens: int = LOT_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document, with its ids (little-endian unsigned 32-bit) and its place.

    Columns: doc_id, start (its document's ids before it), length, doc_tokens (end id included), sequence_id,
    offset (place in the sequence, gapless from 0), window (the sequence's length), step_group, ids. Every id
    is in exactly one piece. A null or empty text is its end id alone; repeated rows are packed as often as
    they occur; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    if any(t & (t - 1) for t in tiers) or sorted(tiers) != list(tiers):
        raise ValueError("tiers are rising powers of two")
    path = vocabulary or vocabulary_path()

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        base = TaskContext.get().partitionId() * PARTITION_STRIDE
        sequences = groups = 0
        end = np.array([END_ID], ID).tobytes()
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def packed() -> dict:
            nonlocal sequences, groups, held, tokens
            width = ID.itemsize
            windows = plan_windows([len(ids) // width for _, ids in held], tiers)
            sizes = [sum(p[2] for p in w) for w in windows]
            group_of = step_groups(sizes, step_tokens)
            rows = []
            for window, size, group in zip(windows, sizes, group_of):
                offset = 0
                for doc, start, length in window:
                    doc_id, ids = held[doc]
                    rows.append((
                        doc_id, start, length, len(ids) // width, base + sequences, offset, size,
                        base + groups + group, ids[start * width : (start + length) * width],
                    ))
                    offset += length
                sequences += 1
            groups += max(group_of, default=-1) + 1
            held, tokens = [], 0
            return by_column(rows, SCHEMA)

        for part in slices:
            for doc_id, ids in zip(part["doc_id"], encoder(path).encode([t or "" for t in part["text"]])):
                held.append((doc_id, ids + end))
                tokens += len(ids) // ID.itemsize + 1
                if tokens >= lot_tokens:
                    yield packed()
        if held:
            yield packed()

    return map_columns(texts_of(docs), work, SCHEMA)


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"
    )
