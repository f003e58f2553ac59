"""Importance resampling towards a target distribution, over hashed word n-grams.

A segment of text, lower-cased and with every delimiter as one space, is scanned by an Aho-Corasick automaton whose
patterns are the segment's distinct words between spaces. A pattern carries the word's CRC-32 and length, and
the scan emits these payloads in order. The CRC of an n-gram is composed of those of adjacent payloads, so no
n-gram is ever written out, and its remainder is the bucket. Buckets are stored per document once; they are
counted by bucket, and scored with the gain of each bucket, a table as long as there are buckets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm import blocks
from scanloom.llm.common import texts_of
from scanloom.operators.ordering import CHUNK, range_chunks
from scanloom.operators.staging import stage

ORDER = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text under one automaton.
SEGMENT_BYTES = 4 << 20
#: Longer words stay out of the automaton; a mark that no word can hold stands for each.
LONGEST_WORD = 64
LONG_WORD = re.compile(rb"[^ ]{%d,}" % (LONGEST_WORD + 1))
#: The bytes that stand in words, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] once A-Z are lower-cased.
IN_WORDS = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Fixed value: the polynomial of CRC-32, lowest term in the highest bit.
POLYNOMIAL = 0xEDB88320
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"
RESULT = ("doc_id", "n_features", "weight", "score", "rank")


def _plain(byte: int) -> int:
    lowered = byte + 32 if 65 <= byte <= 90 else byte
    return lowered if lowered in IN_WORDS else 32


NORMAL = bytes(map(_plain, range(256)))


def _over_bits(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by what it makes of every byte at each of the four places."""
    out = table[0, values & 255]
    for place in (1, 2, 3):
        out = out ^ table[place, (values >> np.uint32(8 * place)) & 255]
    return out


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """The map of a CRC register over ``2 ** power`` zero bytes."""
    if power == 0:
        crc = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
        table = np.empty((4, 256), np.uint32)
        table[0] = crc
        for place in (1, 2, 3):
            table[place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * (place - 1))
        return table
    half = _zeros(power - 1)
    return np.stack([_over_bits(half, half[place]) for place in range(4)])


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings put together, from their CRCs and the length of the second."""
    out = first
    for power in range(int(length.max(initial=0)).bit_length()):
        on = (length >> power) & 1 == 1
        out = np.where(on, _over_bits(_zeros(power), out), out)
    return out ^ second


def segments(batches: Iterator[pa.RecordBatch], size: int = SEGMENT_BYTES) -> Iterator[tuple[pa.Array, list[tuple[int, bytes]]]]:
    """Rows, and their normalised texts in runs of about ``size`` bytes as (row, bytes); a longer text comes in several
    runs, cut at spaces. The doc_ids come with the last run of their rows."""
    for piece in blocks.slices(batches, size=size):
        texts = [(t or "").encode("utf-8", "surrogatepass").translate(NORMAL) for t in piece.column("text").to_pylist()]
        if len(texts) > 1 or len(texts[0]) <= 2 * size:
            yield piece.column("doc_id"), list(enumerate(texts))
            continue
        text, start = texts[0], 0
        while len(text) - start > 2 * size:
            cut = text.find(b" ", start + size)
            if cut < 0:
                break
            yield None, [(0, text[start:cut])]
            start = cut
        yield piece.column("doc_id"), [(0, text[start:])]


def payloads(texts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, CRC-32 and length of every word of a run of texts, in order, as its automaton emits them."""
    import ahocorasick

    long_words: list[bytes] = []

    def mark(found: re.Match) -> bytes:
        long_words.append(found.group())
        return b"\x01%d" % (len(long_words) - 1)

    run = b" " + b" ".join(text for _, text in texts) + b" "
    ends = np.cumsum([len(text) + 1 for _, text in texts])
    if LONG_WORD.search(run):
        shorter = [LONG_WORD.sub(mark, text) for _, text in texts]
        run = b" " + b" ".join(shorter) + b" "
        ends = np.cumsum([len(text) + 1 for text in shorter])
    words = list(set(run.split()))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for at, word in enumerate(words):
        automaton.add_word(f" {word.decode('latin-1')} ", at)
    automaton.make_automaton()
    meant = [long_words[int(word[1:])] if word[:1] == b"\x01" else word for word in words]
    crcs = np.fromiter(map(zlib.crc32, meant), np.uint32, len(meant))
    lengths = np.fromiter(map(len, meant), np.int64, len(meant))
    found = np.fromiter(chain.from_iterable(automaton.iter(run.decode("latin-1"))), np.int64).reshape(-1, 2)
    rows = np.array([row for row, _ in texts])[np.searchsorted(ends, found[:, 0] - 1)]
    return rows, crcs[found[:, 1]], lengths[found[:, 1]]


def composed(rows: np.ndarray, crcs: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and CRC-32 of all runs of 1 to ``order`` adjacent words of a row, joined by a space."""
    space = np.uint32(zlib.crc32(b" "))
    out_rows, out_crcs = [rows], [crcs]
    grams = crcs
    for n in range(2, order + 1):
        if len(rows) < n:
            break
        # The n-gram that starts at each word: the shorter one there, a space, and the word that follows.
        spaced = joined_crc(grams[:-1], np.full(len(grams) - 1, space), np.ones(len(grams) - 1, np.int64))
        grams = joined_crc(spaced, crcs[n - 1 :], lengths[n - 1 :])
        same = rows[: len(grams)] == rows[n - 1 :]
        out_rows.append(rows[: len(grams)][same])
        out_crcs.append(grams[same])
    return np.concatenate(out_rows), np.concatenate(out_crcs)


def features(docs: DataFrame, order: int = ORDER, buckets: int = BUCKETS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Per row: doc_id, n_words, n_features and the buckets of the features as integers of 2 or 4 bytes, in any order."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for ids, texts in segments(batches, segment_bytes):
            held.append(payloads(texts))
            if ids is None:
                continue
            rows, crcs, lengths = (np.concatenate(part) for part in zip(*held))
            held = []
            n_words = np.bincount(rows, minlength=len(ids))
            rows, crcs = composed(rows, crcs, lengths, order)
            sort = np.argsort(rows, kind="stable")
            n_features = np.bincount(rows, minlength=len(ids))
            ends = np.concatenate([[0], np.cumsum(n_features)])
            data = (crcs[sort] % np.uint32(buckets)).astype(dtype)
            yield {
                "doc_id": ids, "n_words": n_words, "n_features": n_features,
                "buckets": [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])],
            }

    return blocks.map_rows(texts_of(docs), work, FEATURES)


def counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and how many features it has, ``n``: one partial row per bucket and task."""
    dtype = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("buckets"):
                n += np.bincount(np.frombuffer(value.as_buffer(), dtype), minlength=buckets)
        at = np.flatnonzero(n)
        yield {"bucket": at, "n": n[at]}

    partial = blocks.map_rows(found.select("buckets"), work, "bucket int, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket in thousandths: log of its share in the target over that in the source, smoothed."""
    whole = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = (
        whole.join(source.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    )
    # As many rows as there are buckets.
    rows = sorted(both.collect())
    in_source, in_target = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    s, t = (np.array([r[c] for r in rows], np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (in_source + buckets) / ((s + 1) * (in_target + buckets)))).astype(np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and ``weight``, the floored mean gain of the features (0 without any)."""
    dtype = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            n = batch.column("n_features").to_pylist()
            weight = [
                int(gain[np.frombuffer(value.as_buffer(), dtype)].sum()) // k if k else 0
                for value, k in zip(batch.column("buckets"), n)
            ]
            yield {c: batch.column(c) for c in ("doc_id", "n_words", "n_features")} | {"weight": weight}

    return blocks.map_rows(found, work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw in thousandths from a hash of the seed and the id (``null`` for none), floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``rank`` for the best floor(percent / 100) of the documents of at least ``min_words`` words, by score, then doc_id.

    Documents are range-partitioned by that order, and a rank is a place in the chunk plus the rows of the
    chunks before. A last key from the row's place lets the splitters cut rows that tie on everything.
    """
    fit = scored.filter(F.col("n_words") >= min_words).withColumns(
        {"_best": -F.col("score"), "_id": F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), "_tie": F.monotonically_increasing_id()}
    )
    order = ["_best", "_id", "n_features", "weight", "_tie"]
    chunked = range_chunks(fit, order, "ranked")
    sizes = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    # One row per chunk, so at most as many as there are shuffle partitions.
    upto = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        CHUNK, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(Window.partitionBy()) * percent / 100).alias("_drawn"),
    )
    place = F.row_number().over(Window.partitionBy(CHUNK).orderBy(*order)) + F.col("_before")
    placed = chunked.join(F.broadcast(offsets), CHUNK).withColumn("_place", place)
    rank = F.when(F.col("_place") <= F.col("_drawn"), F.col("_place")).cast("long").alias("rank")
    rest = scored.filter(F.col("n_words") < min_words).select(*RESULT[:4], F.lit(None).cast("long").alias("rank"))
    return placed.select(*RESULT[:4], rank).unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    percent: int = PERCENT, seed: int = SEED, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (1, 2, ... of those drawn, else null).

    Whole texts of any length are read. A null or empty text has no words, hence no features, weight 0 and no
    rank. Repeated rows count and are drawn one by one; a null doc_id draws as ``null`` and comes last among equal
    scores; other columns are ignored; an empty table gives no rows, an empty target leaves all gains to smoothing.
    """
    found = stage(features(docs, order, buckets, segment_bytes), "features")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(counts(found, buckets), counts(features(wanted, order, buckets, segment_bytes), buckets), buckets)
    scored = stage(
        weighed(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weighed"
    )
    return ranked(scored, min_words, percent)
