"""Exact duplicates by content sort.

Normalised texts are dealt by sampled splitters (``repartitionByRange``) into ranges of their bytes, every
range is sorted on its own (Spark's external sort, which spills), and equal texts stand next to each other.
The window over the full text compares each text with its neighbour, so no decision rests on a hash. The
sort key begins with a short prefix and a 64-bit hash, so splitters stay small however long a text is, and
a first line that many texts share does not make a hot range.

A text whose copies would fill half a range is found in a sample; its copies get a salt, which lets the
splitters cut them. Each cut leaves one representative, and the representatives, at most one per salt, are
sorted once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import partitions, unused, without_spaces
from scanloom.operators.staging import stage

PREFIX_CHARS = 12
SAMPLE_PER_RANGE = 40
LEAST_SAMPLE = 5_000


def _hot_hashes(keyed: DataFrame, key: str, ranges: int) -> DataFrame | None:
    """Hashes that hold half a range or more in a sample: at most ``2 * ranges`` rows, None if there are none."""
    rows = keyed.count()
    wanted = max(LEAST_SAMPLE, SAMPLE_PER_RANGE * ranges)
    sampled = keyed if rows <= wanted else keyed.sample(wanted / rows, seed=7)
    hot = (
        sampled.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= max(4, min(rows, wanted) // (2 * ranges)))
        .select(key).collect()
    )
    if not hot:
        return None
    return keyed.sparkSession.createDataFrame([(r[0],) for r in hot], f"{key} long")


def _winners(df: DataFrame, keys: list[str], chars: str, doc_id: str, size, names: list[str]) -> DataFrame:
    """Add keep id, group size and place in the group, over rows in which equal texts are neighbours."""
    order = Window.partitionBy(*keys).orderBy(F.desc(chars), F.asc_nulls_last(doc_id))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({
        names[0]: F.first(doc_id).over(whole),
        names[1]: F.sum(size).over(whole),
        names[2]: F.row_number().over(order),
    })


def _runs(docs: DataFrame, ranges: int | None):
    """Every row with its place among equal texts of its range; the name of each working column."""
    spark = docs.sparkSession
    ranges = ranges or partitions(spark)
    w = dict(zip(
        ("norm", "chars", "prefix", "hash", "salt", "keep", "size", "place"),
        unused(docs.columns, "_norm", "_chars", "_prefix", "_hash", "_salt", "_keep", "_size", "_place"),
    ))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn(w["norm"], without_spaces(text)).withColumns({
        w["chars"]: F.char_length(text),
        w["prefix"]: F.substring(w["norm"], 1, PREFIX_CHARS),
        w["hash"]: F.xxhash64(w["norm"]),
    })
    hot = _hot_hashes(keyed, w["hash"], ranges)
    keys = [w["prefix"], w["hash"]]
    if hot is not None:
        # At most 2 * ranges rows by construction, so the broadcast is bounded.
        flag = hot.withColumn(w["salt"], F.lit(True))
        keyed = keyed.join(F.broadcast(flag), w["hash"], "left")
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ranges)).cast("int") + 1
        keyed = keyed.withColumn(w["salt"], F.when(F.col(w["salt"]), dealt).otherwise(F.lit(0)))
        keys.append(w["salt"])
    # The window asks for no other partitioning than these ranges, so the texts are shuffled once.
    local = _winners(
        keyed.repartitionByRange(ranges, *keys), [*keys, w["norm"]], w["chars"], "doc_id", F.lit(1),
        [w["keep"], w["size"], w["place"]],
    )
    return local, w, hot is not None


def mark_copies(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting white space (null counts as empty). In each group
    the row with the most code points in the original text stays, then the one with the smallest doc_id; of
    rows that tie on both, one. A null doc_id comes after all others. Other columns are ignored, and an empty
    table gives an empty result.
    """
    local, w, salted = _runs(docs.select("doc_id", "text"), ranges)
    narrow = local.withColumn("text_sha256", F.sha2(w["norm"], 256))
    if salted:
        head = (F.col(w["salt"]) > 0) & (F.col(w["place"]) == 1)
        narrow = stage(
            narrow.drop("text").withColumn(w["norm"], F.when(head, F.col(w["norm"]))), "content-runs"
        )
        heads = narrow.filter((F.col(w["salt"]) > 0) & (F.col(w["place"]) == 1))
        merged = _winners(
            heads, [w["prefix"], w["hash"], w["norm"]], w["chars"], "doc_id", F.col(w["size"]),
            ["_keep_all", "_size_all", "_place_all"],
        ).select(w["salt"], "text_sha256", "_keep_all", "_size_all", "_place_all")
        # One row per hot text and salt: 2 * ranges texts with ``ranges`` salts each at the very most.
        narrow = narrow.join(merged, [w["salt"], "text_sha256"], "left").withColumns({
            w["keep"]: F.when(F.col("_place_all").isNull(), F.col(w["keep"])).otherwise(F.col("_keep_all")),
            w["size"]: F.coalesce("_size_all", w["size"]),
            w["place"]: F.when(F.col("_place_all") > 1, F.lit(2)).otherwise(F.col(w["place"])),
        })
    return narrow.select(
        "doc_id", F.col(w["keep"]).alias("keep_id"), F.col(w["size"]).cast("long").alias("group_size"),
        (F.col(w["place"]) == 1).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the rule is that of ``mark_copies``."""
    local, w, salted = _runs(docs, ranges)
    first = local.filter(F.col(w["place"]) == 1)
    if not salted:
        return first.select(*docs.columns)
    kept = stage(first.drop(w["keep"], w["place"]), "content-heads")
    heads = _winners(
        kept.filter(F.col(w["salt"]) > 0), [w["prefix"], w["hash"], w["norm"]], w["chars"], "doc_id",
        F.col(w["size"]), [w["keep"], f"{w['size']}_all", w["place"]],
    ).filter(F.col(w["place"]) == 1)
    return kept.filter(F.col(w["salt"]) == 0).select(*docs.columns).unionByName(heads.select(*docs.columns))
