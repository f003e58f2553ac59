"""Tables updated where they lie."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scanloom.operators import lifecycle as lc
from scanloom.operators import staging
from scanloom.schemas import ASSET_DIFF, columns
from scanloom.sources import merging


def rows_of(df):
    return sorted(map(str, df.collect()))


def files_of(path):
    return {str(f): os.stat(f).st_mtime_ns for f in Path(path).rglob("*.parquet")}


def diff(spark, *rows):
    names = columns(ASSET_DIFF)
    return spark.createDataFrame([tuple({"subject_id": s, "modality": m, "reason": r}.get(c, "") for c in names) for s, m, r in rows],
                                 ", ".join(f"{c} STRING" for c in names))


def test_the_diff_log_keeps_rows_once_and_other_partitions_untouched(spark, tmp_path):
    path = str(tmp_path / "log")
    assert merging.current(spark, path) is None
    first = diff(spark, *[(f"s{i}", "T1w", "a") for i in range(40)])
    merging.add_to_diff_log(spark, path, first, buckets=16)
    before = files_of(path)
    new = diff(spark, ("s1", "T1w", "a"), ("s1", "T1w", "b"), ("s1", "T1w", "b"))
    touched = merging.add_to_diff_log(spark, path, new)
    assert len(touched) == 1
    assert rows_of(merging.current(spark, path)) == rows_of(first.unionByName(new).distinct())
    changed = {f for f in before if files_of(path).get(f) != before[f]}
    assert all(f"_bucket={touched[0]}/" in f for f in changed) and len(changed) < len(before)
    assert merging.add_to_diff_log(spark, path, new.limit(0)) == []


def test_an_update_leaves_nothing_but_the_table_and_deals_rows_by_their_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    rows = diff(spark, *[(f"s{i}", "T1w", "a") for i in range(400)])
    monkeypatch.setattr(staging, "BUCKET_ROWS", 10)
    moved = []
    deal = merging.stage
    monkeypatch.setattr(merging, "stage", lambda df, label: moved.append(df) or deal(df, label))
    before = set(staging._made.get(spark.sparkContext.applicationId, []))
    for part in (rows.limit(200), rows):
        merging.add_to_diff_log(spark, path, part, buckets=64)
    assert set(staging._made.get(spark.sparkContext.applicationId, [])) <= before
    assert rows_of(merging.current(spark, path)) == rows_of(rows)
    plan = moved[-1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_bucket" in plan and ", 60)" in plan  # 600 rows, stored and new


STATE = "k STRING, ts BIGINT, stage STRING, message STRING, started_at STRING, cleared ARRAY<STRING>"


def test_states_take_updates_as_they_come(spark, tmp_path):
    path = str(tmp_path / "states")
    one = [("a", 1, "queued", "m", "t1", None), ("b", 1, "queued", None, None, None), (None, 1, "queued", None, None, None)]
    two = [("a", 2, "failed", None, "t2", ["message"]), ("c", 5, "linking", "x", "t5", None), (None, 3, "linking", "n", None, None)]
    for part in (one, two):
        merging.update_states(spark, path, spark.createDataFrame(part, STATE), "k", ["ts"], buckets=4)
    whole = lc.merged_state(spark.createDataFrame(one + two, STATE), "k", ["ts"])
    assert rows_of(merging.current(spark, path).select(*whole.columns)) == rows_of(whole)


def test_participants_gain_subjects_and_keep_columns(spark, tmp_path):
    path = str(tmp_path / "participants")
    merging.update_participants(spark, path, spark.createDataFrame([(f"p{i}", "x") for i in range(20)], "subject_id STRING, center STRING"), buckets=8)
    merging.update_participants(spark, path, spark.createDataFrame([("p3", "y"), ("new", "y")], "subject_id STRING, center STRING"))
    got = {r.participant_id: r.site_id for r in merging.current(spark, path).collect()}
    assert len(got) == 21 and got["sub-p3"] == got["sub-new"] != got["sub-p4"]


def test_a_failed_update_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    start = spark.createDataFrame([(i, "old") for i in range(30)], "k BIGINT, v STRING")
    put = lambda rows, merge: merging.upsert(spark, path, rows, ["k"], [F.col("k")], merge, 4)
    put(start, lambda old, new: new)
    with pytest.raises(Exception, match="boom"):
        put(start, lambda old, new: new.withColumn("v", F.raise_error(F.lit("boom")).cast("string")))
    assert rows_of(merging.current(spark, path)) == rows_of(start)
    put(start.filter("k = 1"), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    put(merging.current(spark, path).select("k", "v"), lambda old, new: old.limit(0))
    assert not files_of(path) and merging.current(spark, path) is None
    put(start, lambda old, new: new)
    assert rows_of(merging.current(spark, path)) == rows_of(start)
