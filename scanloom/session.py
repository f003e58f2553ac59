"""Session settings this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot leaves methods above 8000 bytes of bytecode uncompiled. Header rows are wide, so their
# whole-stage methods can exceed that; below this limit Spark splits the code instead.
HUGE_METHOD_LIMIT = "8000"


def configure(spark: SparkSession) -> SparkSession:
    """Settings that can change at run time; those that name resources stay as the cluster has them."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Tables that are bucketed by a part of a join's keys need no exchange for it.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark
