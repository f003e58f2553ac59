"""Checking a corpus of files before it is published."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.text import file_name, parent_dir
from scanloom.params import ReleasePolicy


def _contains_any(text: Column, words: Iterable[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def release_corpus(files: DataFrame, policy: ReleasePolicy = ReleasePolicy()) -> DataFrame:
    """(path, length, text) of a ``binaryFile`` scan; text is null when it is not UTF-8.

    The content of a file above ``max_bytes`` is never read: its size is already the problem.
    """
    content = F.col("content").cast("string")
    small = files.filter(F.col("length") <= policy.max_bytes).select(
        "path", "length", F.when(F.is_valid_utf8(content), content).alias("text")
    )
    large = files.filter(F.col("length") > policy.max_bytes).select(
        "path", "length", F.lit(None).cast("string").alias("text")
    )
    return small.unionByName(large)


def to_check(corpus: DataFrame, policy: ReleasePolicy = ReleasePolicy()) -> DataFrame:
    """Leave out build folders and files that are never published."""
    folders = F.split(parent_dir(F.col("path")), "/")
    skipped = (
        F.arrays_overlap(folders, F.array(*[F.lit(d) for d in policy.excluded_directories]))
        | F.col("path").rlike(r"(^|/)[^/]*\.egg-info/")
        | file_name(F.col("path")).isin(*policy.excluded_files)
    )
    return corpus.filter(~skipped)


def release_problems(corpus: DataFrame, policy: ReleasePolicy = ReleasePolicy()) -> DataFrame:
    """Distinct problems of a corpus (path, length, text); map-only up to the final distinct."""
    path = F.col("path")
    low_path, low_text = F.lower(path), F.lower(F.col("text"))
    has_suffix = F.lit(False)
    for suffix in policy.prohibited_suffixes:
        has_suffix = has_suffix | low_path.endswith(suffix)
    oversized = F.col("length") > policy.max_bytes
    opened = ~oversized & F.col("text").isNotNull()
    lowered = [m.lower() for m in policy.secret_markers]
    checks = [
        (_contains_any(low_path, policy.forbidden_tokens), "forbidden token in filename: "),
        (has_suffix, "prohibited data or credential extension: "),
        (oversized, f"file exceeds {policy.max_bytes} bytes: "),
        (~oversized & F.col("text").isNull(), "unexpected binary file: "),
        (opened & _contains_any(low_text, policy.forbidden_tokens), "forbidden token in content: "),
        (
            opened & _contains_any(F.col("text"), policy.private_paths),
            "private absolute path in content: ",
        ),
        (opened & _contains_any(low_text, lowered), "possible credential in content: "),
    ]
    labels = F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in checks]))
    return corpus.select("path", F.explode(labels).alias("label")).select(
        F.concat("label", "path").alias("problem")
    ).distinct()
