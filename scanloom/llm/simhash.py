"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints at 4 or fewer differing bits are linked, and linked documents form components. Equal
fingerprints are merged first. A vantage point's distance over all 64 bits separates badly at this radius:
unrelated fingerprints lie 32 +- 4 bits away, so most of them would be in the band that both sides of a
boundary must search, at every level. The upper levels therefore measure the distance within a few of
``PIECES`` bit pieces: 4 differing bits leave at least ``PIECES - 4`` pieces untouched, and in one tree per
choice of pieces the triangle bound is zero, |d(x, v) - d(y, v)| <= 0, so linked fingerprints meet in the
same leaf of at least one tree, whatever the vantage points are. Leaves are the shards; inside one the tree
goes on over all 64 bits with radius 4 (``vantage``), where the boundaries' overlaps are compared. Shards
above ``SHARD_ROWS`` are cut into slices, and every two slices meet in a task of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_columns, partitions, texts_of, unused
from scanloom.llm.components import components
from scanloom.llm.vantage import linked
from scanloom.operators.staging import stage

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Bit pieces. Five give 13-bit shards; more pieces give longer keys and more trees, for more documents.
PIECES = 5
VANTAGES = 6
SHARD_ROWS = 20_000
CELL_ROWS = 20_000
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles of one text, as an unsigned number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= SHINGLE_WORDS:
        starts, ends = starts[: len(words) - SHINGLE_WORDS + 1], ends[SHINGLE_WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        pieces = (joined[a:b] for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist()))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and ``fp``, the fingerprint's bits as a signed long."""

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        for rows in slices:
            found = np.array([fingerprint(t) for t in rows.pop("text")], np.uint64).view(np.int64)
            yield rows | {"fp": found}

    keyed = texts_of(docs).withColumn("text_key", text_key())
    return map_columns(keyed, work, "doc_id long, text_key long, fp long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def piece_masks(pieces: int) -> list[int]:
    """One mask for every choice of pieces that 4 differing bits can leave untouched."""
    if pieces <= RADIUS:
        raise ValueError(f"more than {RADIUS} pieces are needed")
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in itertools.combinations(single, pieces - RADIUS)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shards(distinct: DataFrame, pieces: int) -> DataFrame:
    """(tree, leaf, fp): every fingerprint in its leaf of every tree, by distances to fixed vantage points."""
    fp = F.col("fp")
    trees = []
    for number, mask in enumerate(piece_masks(pieces)):
        leaf = F.lit(0).cast("long")
        for level in range(VANTAGES):
            vantage = xxhash.xxh64_intdigest(f"vantage {level}", SEED)
            inside = fp.bitwiseXOR(F.lit(_signed(vantage))).bitwiseAND(F.lit(_signed(mask)))
            leaf = F.shiftleft(leaf, 7).bitwiseOR(F.bit_count(inside).cast("long"))
        trees.append(F.struct(F.lit(number).alias("tree"), leaf.alias("leaf")))
    return distinct.select("fp", F.inline(F.array(*trees)))


def near_links(distinct: DataFrame, pieces: int = PIECES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) between fingerprints that connect exactly those joined by links of <= 4 bits."""
    shards = _shards(distinct.select("fp"), pieces)
    large = (
        shards.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
        .select("tree", "leaf", F.ceil(F.col("n") / shard_rows).cast("int").alias("slices"))
    )
    mine = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda other: F.struct(
            F.least(other, F.col("mine")).alias("i"), F.greatest(other, F.col("mine")).alias("j")
        ),
    )
    tasks = (
        shards.join(large, ["tree", "leaf"], "left").fillna(1, ["slices"]).withColumn("mine", mine)
        .select("tree", "leaf", "mine", "fp", F.inline(meets))
    )

    # Small leaves share a task: a cell holds about CELL_ROWS rows, or one pair of slices of a large leaf.
    cells = -(-distinct.count() * len(piece_masks(pieces)) // CELL_ROWS) or 1
    keys = ["tree", "leaf", "i", "j"]

    def work(cell: pd.DataFrame) -> pd.DataFrame:
        key = np.stack([cell[k].to_numpy(np.int64) for k in keys])
        order = np.lexsort(key)
        key, fps = key[:, order], cell["fp"].to_numpy()[order].view(np.uint64)
        mine = cell["mine"].to_numpy()[order]
        cuts = np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1
        found = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)]):
            if b - a > 1:
                i, j = key[2, a], key[3, a]
                side = mine[a:b] == i
                found.append(
                    linked(fps[a:b], None, RADIUS) if i == j
                    else linked(fps[a:b][side], fps[a:b][~side], RADIUS)
                )
        left, right = (np.concatenate(x) if x else np.array([], np.uint64) for x in (list(zip(*found)) or [[], []]))
        return pd.DataFrame({"a": left.view(np.int64), "b": right.view(np.int64)})

    return (
        tasks.withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(cells)))
        .groupBy("cell").applyInPandas(work, "a long, b long")
    )


def _grouped(docs: DataFrame, pieces: int, shard_rows: int) -> DataFrame:
    """doc_id, text_key, fp and ``head``, the first document of the row's component (smallest doc_id)."""
    marked = stage(fingerprints(docs), "fingerprints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    reps = stage(
        marked.groupBy("fp").agg(F.min(own).alias("head"), F.count(F.lit(1)).alias("n")), "fingerprint-groups"
    )
    roots = components(near_links(reps, pieces, shard_rows)).withColumnRenamed("node", "fp")
    rooted = reps.join(roots, "fp")
    least = rooted.groupBy("root").agg(F.min("head").alias("first"))
    joined = rooted.join(least, "root").select("fp", "first")
    every = stage(
        reps.join(joined, "fp", "left").select("fp", "n", F.coalesce("first", "head").alias("head")), "fingerprint-heads"
    )
    # Fingerprints with more than half a partition of rows: fewer than twice the partitions, so broadcast.
    rows = every.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(1, rows // (2 * partitions(docs.sparkSession)))
    crowd = F.broadcast(every.filter(hot).drop("n"))
    return marked.join(crowd, "fp").unionByName(
        marked.join(crowd, "fp", "left_anti").join(every.filter(~hot).drop("n"), "fp")
    )


def components_of(docs: DataFrame, pieces: int = PIECES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    ``component_id`` is the smallest doc_id that can be reached over links, its own included. A text without
    words (null, empty, only white space) has fingerprint zero and is linked like any other. A null doc_id
    gets its component's smallest id, null if the component has none; repeated rows stay repeated; other
    columns are ignored.
    """
    return _grouped(docs, pieces, shard_rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, pieces: int = PIECES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns are kept.

    Rows alike in doc_id and text are one document here; drop exact copies first.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    loser, key = unused(docs.columns, "_loser", "_loser_key")
    out = _grouped(docs, pieces, shard_rows).filter(~own.eqNullSafe(F.col("head"))).select(
        F.col("doc_id").alias(loser), F.col("text_key").alias(key)
    )
    gone = stage(out.distinct(), "near-copies")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(loser)) & (text_key() == F.col(key))
    return docs.join(gone, same, "left_anti")
