"""Comparing validator reports of two dataset states."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNREADABLE = "validator_result_missing_or_unreadable"


def error_fingerprints(reports: DataFrame, root: str | Column, json_column: str = "json") -> DataFrame:
    """Distinct errors of reports in canonical form, the dataset's own path taken out.

    Keys are sorted by the variant parser. An issue that is text stays as it is; null, true and false are written
    as ``None``, ``True`` and ``False``, other issues that are no objects as JSON. A report that cannot be parsed or
    is null yields one marker.
    """
    path = root if isinstance(root, Column) else F.lit(root)
    escaped = (
        F.substring(F.to_json(F.struct(path.alias("p"))), 6, 1 << 30) if isinstance(root, Column)
        else F.lit(json.dumps(root, ensure_ascii=False)[1:-1])
    )
    if isinstance(root, Column):
        escaped = F.left(escaped, F.length(escaped) - F.lit(2))
    parsed = reports.withColumn("_report", F.try_parse_json(F.col(json_column)))
    errors = F.try_variant_get(F.col("_report"), "$.issues.errors", "array<variant>")
    issues = parsed.select(
        *[c for c in reports.columns],
        F.col("_report").isNull().alias("_unreadable"),
        F.explode_outer(errors).alias("_issue"),
    )
    issue, kind = F.col("_issue"), F.schema_of_variant(F.col("_issue"))
    canonical = F.replace(
        F.replace(F.to_json(issue), escaped, F.lit("<dataset>")), path, F.lit("<dataset>"),
    )
    text = (
        F.when(kind == "STRING", F.try_variant_get(issue, "$", "string"))
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(issue, "$", "string")))
        .when(kind == "VOID", "None")
        .when(F.startswith(kind, F.lit("OBJECT")), canonical)
        .otherwise(F.to_json(issue))
    )
    return (
        issues.withColumn("fingerprint", F.when(F.col("_unreadable"), UNREADABLE).otherwise(text))
        .filter(F.col("fingerprint").isNotNull())
        .select("fingerprint")
        .distinct()
    )


def new_errors(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    return candidate.subtract(baseline)


def compare_errors(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row of counts and verdicts over two fingerprint tables."""
    tagged = baseline.distinct().withColumn("_b", F.lit(1)).join(
        candidate.distinct().withColumn("_c", F.lit(1)), "fingerprint", "full_outer"
    )
    in_b, in_c = F.col("_b").isNotNull(), F.col("_c").isNotNull()
    marker = F.col("fingerprint") == UNREADABLE
    fresh = F.count_if(in_c & ~in_b)
    readable_c = F.count_if(in_c & marker) == 0
    return tagged.agg(
        F.count_if(in_b).alias("baseline_error_count"),
        F.count_if(in_c).alias("candidate_error_count"),
        fresh.alias("new_error_count"),
        (F.count_if(in_b & marker) == 0).alias("baseline_result_readable"),
        readable_c.alias("candidate_result_readable"),
        ((fresh == 0) & readable_c).alias("passed_no_new_errors"),
    )
