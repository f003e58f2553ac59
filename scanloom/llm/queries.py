"""The registered queries of this subpackage: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm import (
    alignment, attention_lm, decontamination, exact_dedup, html_text, importance, language_id,
    packing, pii, sharding, simhash, token_counts, token_files,
)
from scanloom.llm.common import ship, table
from scanloom.llm.oracles import CONTAMINATION, CONTENT_GROUPS, IMPORTANCE, shard_sql
from scanloom.operators.staging import shared_dir

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 16


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), base=SHARDS, added=1)


def op2_disguised_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op3_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components_of(table(spark, sf_dir, "documents"))


def op6_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op8_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(shared_dir(spark))
    token_files.write(table(spark, sf_dir, "documents"), folder)
    return token_files.read(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.learn(docs))
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op11_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows are long here, and what a task holds of them at once is outside Spark's own bounds.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return attention_lm.score(table(spark, sf_dir, "documents"))


def op12_importance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cross_tokenizer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def shipped(query: Query) -> Query:
    """The query with this package at hand for the Python workers."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: shipped(f)
    for f in (
        op1_hash_tree_shards,
        op2_disguised_identifiers,
        op3_text_to_tag_ratio,
        op4_token_counts,
        op5_simhash_components,
        op6_tiered_packing,
        op7_content_sort,
        op8_benchmark_ngrams,
        op9_token_records,
        op10_compression_language,
        op11_attention_scores,
        op12_importance_buckets,
        op13_cross_tokenizer_links,
    )
}

ORACLES: dict[str, str] = {
    "op1_hash_tree_shards": shard_sql(SHARDS),
    "op7_content_sort": CONTENT_GROUPS,
    "op8_benchmark_ngrams": CONTAMINATION,
    "op12_importance_buckets": IMPORTANCE,
}
