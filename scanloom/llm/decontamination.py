"""Benchmark decontamination with a broadcast set of normalised n-grams.

Benchmark items become windows of ``WINDOW_WORDS`` words (an item with fewer words is one window). Their
64-bit hashes form a small table that is broadcast if its size is proven small, and joined by shuffle
otherwise. Every window of every document is hashed and looked up; a hit is verified word by word. All of
it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import lower_ascii, unused

WINDOW_WORDS = 10
#: Benchmark windows that may be broadcast (about 0.3 kB each).
BROADCAST_WINDOWS = 100_000
#: What separates words, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] being a word, before and after
#: A-Z have been lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ANY_CASE_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z lowered. A null text has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def item_windows(benchmark: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """One row per distinct window: its words, their number, hash, and the items that hold it."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    n = F.least(F.size("words"), F.lit(length))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    return (
        own.filter(F.size("words") > 0)
        .select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("window"))
        .groupBy("window", "n").agg(F.collect_set("item").alias("items"))
        .withColumn("h", F.xxhash64("window"))
    )


def hits(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """Per (doc_id, text): text_key, n_words, copies, hit (1-based positions of hit words), items.

    Each document gives one row of its own (window length 0) and one per window; only the own row and verified
    windows leave the scan. They are gathered by doc_id and a hash of the text. Rows alike in both have the
    same answer and are counted in ``copies``.
    """
    windows = item_windows(benchmark, length)
    small = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # ``length`` values at most
    rows = (
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words(F.col("text")).alias("words"))
        .select("*", F.size("words").alias("n_words"), F.explode(F.array(*map(F.lit, [0, *lengths]))).alias("len"))
    )
    last = F.col("n_words") - F.col("len") + 1
    starts = (
        F.when(F.col("len") == 0, F.array(F.lit(0)))
        .when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    )
    window = F.slice("words", F.greatest(F.col("pos"), F.lit(1)), F.col("len"))
    # A probe keeps its own few words, never the document's, so that a join by shuffle stays linear in a text.
    probes = rows.select("*", F.explode(starts).alias("pos")).select(
        "doc_id", "text_key", "n_words", "len", "pos", window.alias("here")
    ).withColumn("h", F.when(F.col("len") > 0, F.xxhash64("here")))
    wanted = windows.select(F.col("h").alias("window_hash"), "window", "items")
    found = probes.join(
        F.broadcast(wanted) if small else wanted,
        (F.col("h") == F.col("window_hash")) & (F.col("here") == F.col("window")), "left",
    ).filter((F.col("len") == 0) | F.col("window_hash").isNotNull())
    covered = F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)
    return found.groupBy("doc_id", "text_key", "n_words").agg(
        F.count_if(F.col("len") == 0).alias("copies"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("len") > 0, covered)))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def report(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean; an empty benchmark leaves all clean; a null item_id is not
    an item that can be named, so its windows mark words but do not count as an item. Repeated rows stay
    repeated; other columns are ignored.
    """
    found = hits(docs, benchmark, length)
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", length: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out (``remove="spans"``).

    All columns are kept, and so is what separates the words that are cut out.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    key, doc, hit = unused(docs.columns, "_text_key", "_doc", "_hit")
    found = hits(docs, benchmark, length).filter(F.size("hit") > 0).select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("hit").alias(hit)
    )
    same = docs["doc_id"].eqNullSafe(found[doc]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found[key]
    )
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    raw = F.filter(F.split("text", ANY_CASE_SEPARATORS), lambda w: w != "")
    between = F.split("text", ANY_CASE_WORD)
    kept = F.transform(
        raw,
        lambda w, i: F.concat(F.when(F.array_contains(hit, i + 1), "").otherwise(w), F.get(between, i + 1)),
    )
    cut = F.when(F.col(hit).isNull(), F.col("text")).otherwise(
        F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))
    )
    return docs.join(found, same, "left").select(
        *[cut.alias("text") if c == "text" else docs[c] for c in docs.columns]
    )
