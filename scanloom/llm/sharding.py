"""Shards by a hierarchical weighted hash tree: region, then rack, then shard.

At each level a document draws a number for every child from a hash of its id and the child's name, divided
by the child's weight, and descends to the smallest draw. Changing the weights below one node therefore moves
documents only into or out of that node. A shard that is added later opens a branch of its own at the top,
labelled with the region it stands in, so that it takes documents only into itself and no other two shards
exchange any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.operators.ordering import CHUNK, range_chunks

SHARDS_PER_RACK = 2
RACKS_PER_REGION = 2
#: Hexadecimal digits of the digest that make one draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Leaf:
    branch: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(base: int, added: int = 0) -> list[Leaf]:
    """A tree of ``base`` shards of equal weight, and ``added`` later ones in branches of their own."""
    regions = max(1, -(-base // (SHARDS_PER_RACK * RACKS_PER_REGION)))
    leaves = []
    for shard in range(base + added):
        region = shard // (SHARDS_PER_RACK * RACKS_PER_REGION) % regions
        rack = shard // SHARDS_PER_RACK % RACKS_PER_REGION
        branch = f"region{region}" if shard < base else f"region{region}+{shard}"
        leaves.append(Leaf(branch, f"{branch}/rack{rack}", shard))
    return leaves


def _children(leaves: list[Leaf]) -> dict[str, dict[str, float]]:
    """Weight of every child by its parent's name; the weight of a node is the sum of what hangs below."""
    tree: dict[str, dict[str, float]] = {}
    for leaf in leaves:
        for parent, child in (
            ("", leaf.branch), (leaf.branch, leaf.rack), (leaf.rack, f"{leaf.rack}/{leaf.shard}")
        ):
            tree.setdefault(parent, {})
            tree[parent][child] = tree[parent].get(child, 0.0) + leaf.weight
    return tree


def _draw(key: Column, child: str, weight: float) -> Column:
    digest = F.substring(F.md5(F.concat(key, F.lit(f"|{child}"))), 1, DRAW_DIGITS)
    unit = (F.conv(digest, 16, 10).cast("double") + 1) / F.lit(float(16**DRAW_DIGITS + 1))
    return -F.log(unit) / F.lit(weight)


def _descend(key: Column, tree: dict[str, dict[str, float]], node: str) -> Column:
    """Name of the shard below ``node``; only the branch that wins is evaluated further."""
    children = tree[node]
    if len(children) == 1:
        child = next(iter(children))
        return _descend(key, tree, child) if child in tree else F.lit(child)
    best = F.least(*[F.struct(_draw(key, c, w).alias("d"), F.lit(c).alias("c")) for c, w in sorted(children.items())])["c"]
    if not any(c in tree for c in children):
        return best
    chosen = None
    for child in sorted(children):
        below = _descend(key, tree, child)
        chosen = F.when(best == child, below) if chosen is None else chosen.when(best == child, below)
    return chosen


def shard_of(doc_id: Column, leaves: list[Leaf]) -> Column:
    """The shard of a document; a null id is a key like any other."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.element_at(F.split(_descend(key, _children(leaves), ""), "/"), -1).cast("int")


def assign(docs: DataFrame, base: int = 16, added: int = 1) -> DataFrame:
    """Every row with its shard, its slot there, and its shard once ``added`` shards have joined.

    Returns doc_id, size (UTF-8 bytes of the text plus 1, a null text has none), text_crc32, law (``key``),
    shard, slot, grown_shard. Slots are gapless from 0 in each shard, by doc_id (nulls first), then
    text_crc32; rows that tie on both are alike. Only doc_id and the shard count decide, so repeated ids share
    a shard. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), layout(base)).alias("shard"),
        shard_of(F.col("doc_id"), layout(base, added)).alias("grown_shard"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["shard", "doc_id", "text_crc32", "_tie"]
    chunked = range_chunks(rows, order, "shard-slots")
    # One row per chunk and shard; chunks are ranges of (shard, doc_id), so about chunks + shards rows.
    counts = chunked.groupBy("shard", CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("shard").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", CHUNK, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", CHUNK).orderBy(*order[1:])
    return chunked.join(F.broadcast(offsets), ["shard", CHUNK]).select(
        "doc_id", "size", "text_crc32", "law", "shard",
        (F.row_number().over(inside) - 1 + F.col("_before")).cast("long").alias("slot"), "grown_shard",
    )
