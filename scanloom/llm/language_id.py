"""Language identification by compression.

Each language gets a zstandard dictionary of raw content from a bounded sample of labelled texts. A text is
lowered, runs of other characters than letters and their marks become one space, and it is cut into chunks of
``CHUNK_BYTES``; every chunk is compressed with every dictionary, and the language with the smallest total
wins: its dictionary holds the text's words. Chunks keep the dictionary's share of the matches alike in short
and long texts. A decision is rejected when the runner-up is larger by fewer bytes than a fixed share of it, in
whole bytes; that margin grows from zero with the text, so short texts are kept without a rule of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scanloom.llm.blocks import slices

#: Bounds of the sample that dictionaries are made of; prediction always reads whole texts.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 1_000
#: The languages share this many texts, at most SAMPLE_DOCS each.
ALL_SAMPLE_DOCS = 25_600
MAX_LANGUAGES = 4_096
SPARE = 3
HASHES = 1 << 31
CHUNK_BYTES = 1_024
LEVEL = 6
#: A text is rejected when its two smallest totals differ by less than this share of the second, in whole bytes.
MARGIN = 0.002
UNKNOWN = "und"
NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
_MADE = StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a quarter, by a checksum of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content per language: the first ``SAMPLE_CHARS`` of ``SAMPLE_DOCS`` texts each, fewer if very many
    languages share ``ALL_SAMPLE_DOCS``.

    Uses rows with text and lang that are not held out, those with the smallest hashes of their id. A bound
    on a hash of id and text, from the number of the language's rows, lets about ``SPARE`` times as many rows through, so
    that what is ranked and collected is small however many rows a language has. A language that so gets too few
    rows, as when most of its rows are alike, is ranked without a bound. Of more than ``MAX_LANGUAGES`` labels, most of
    which can be no languages, the most frequent are learned.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    wanted = min(SAMPLE_DOCS, max(1, ALL_SAMPLE_DOCS // len(counts)))
    # One row per language, MAX_LANGUAGES at most.
    bounds = F.broadcast(docs.sparkSession.createDataFrame(
        [(r["lang"], min(HASHES, SPARE * wanted * HASHES // r["n"])) for r in counts], "lang string, bound long"
    ))
    hashed = usable.select(
        "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)).alias("id_hash"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASHES)).alias("h"),
    )
    # Copies of a row are one, so that no group of them is ranked row by row.
    cut = hashed.join(bounds, "lang").filter(F.col("h") < F.col("bound")).drop("bound").distinct()
    ranked = cut.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("id_hash", "h", "text")))
    content: dict[str, list] = {}
    for row in sorted(ranked.filter(F.col("place") <= wanted).collect(), key=lambda r: (r["lang"], r["place"])):
        content.setdefault(row["lang"], []).append(row["text"])
    for lang, n in counts:
        if n > SPARE * wanted and len(content.get(lang, ())) < wanted:
            smallest = hashed.filter(F.col("lang") == lang).distinct().orderBy("h", "text").limit(wanted)
            content[lang] = [row["text"] for row in smallest.collect()]
    return {lang: prepared(" ".join(texts)) for lang, texts in content.items()}


def prepared(text: str) -> bytes:
    """Lower-case words of letters with their marks, by single spaces; nothing without any letter."""
    words = NO_LETTERS.sub(" ", text.lower()).strip()
    return words.encode("utf-8", "surrogatepass") if LETTER.search(words) else b""


def classifier(content: dict[str, bytes]):
    """A function from a text to (language, score, rejected)."""
    models = []
    for lang in sorted(content):
        raw = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        models.append((lang, zstandard.ZstdCompressor(
            level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False
        ).compress))

    def classify(text: str | None) -> tuple[str, float, bool]:
        data = prepared(text or "")
        if not data or not models:
            return UNKNOWN, 0.0, True
        chunks = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
        sizes = sorted((sum(len(compress(c)) for c in chunks), lang) for lang, compress in models)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        apart, second = sizes[1][0] - sizes[0][0], sizes[1][0]
        return sizes[0][1], apart / second, apart < int(MARGIN * second)

    return classify


def _over_batches(docs: DataFrame, content: dict[str, bytes], keep_all: bool):
    """Classify batch by batch in Arrow, so that the other columns pass through untouched whatever their types."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = classifier(content)
        for batch in slices(batches):
            found = [classify(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            lang, score, rejected = zip(*found) if found else ((), (), ())
            if keep_all:
                batch = batch.append_column("lang_pred", pa.array(lang, pa.string()))
                batch = batch.append_column("score", pa.array(score, pa.float64()))
                yield batch.append_column("rejected", pa.array(rejected, pa.bool_()))
            else:
                yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    schema = docs.schema
    if keep_all:
        schema = StructType([*schema.fields, *_MADE.fields])
    return docs.mapInArrow(work, schema)


def predict(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred, score (relative margin, 0 to 1) and rejected; only ``text`` is looked at.

    A null text or one without letters is ``und`` with score 0, and rejected. Texts of any length are read whole; an
    empty table gives no rows. Without any learned language
    every text is. Ties go to the language first in the alphabet. Input columns of those names are replaced.
    """
    return _over_batches(docs.drop(*_MADE.names), content, keep_all=True)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they were."""
    return _over_batches(docs, learn(docs), keep_all=False)
