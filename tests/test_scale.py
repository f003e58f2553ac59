"""How work is dealt to tasks, and how often rows move: what decides at size and does not show in results."""

import re
from itertools import takewhile
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_inventory import SMALL, slices

from scanloom.operators import incremental, staging
from scanloom.operators import inventory as iv
from scanloom.operators.selection import select_series
from scanloom.operators.staging import stage, stage_bucketed
from scanloom.plans import cohort, pipeline, queries, queries_io, queries_work
from scanloom.plans.cohort import cohort_instances, dealt_instances


def test_many_small_files_are_written_by_several_tasks(spark):
    path = queries_io._files(spark, SMALL, "test-files", F.col("s_name"))
    found = [p.name for p in Path(path).rglob("part-*.txt")]
    assert len(found) == spark.read.parquet(f"{SMALL}/supplier.parquet").count()
    assert len({name.split("-")[1] for name in found}) > 1


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def all_of(df):
    return sorted(map(str, df.collect()))


def test_headers_move_once_and_the_selection_stays_in_its_buckets(spark):
    headers = stage(cohort_instances(spark, SMALL), "test-headers")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = iv.inventory(headers, hot_rows=None, buckets=4)
        assert plan_of(rows).count("Exchange hashpartitioning") == 1
        series = stage_bucketed(rows, "test-series", ["subject_id"], 4, dealt=True)
        chosen = select_series(series, small_subjects=True)
        assert "Exchange" not in plan_of(chosen)
        assert all_of(series) == all_of(iv.inventory(headers, hot_rows=None))
        assert all_of(chosen) == all_of(select_series(series))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_subjects_without_a_label_meet_in_either_selection(series):
    rows = series({}, dict(series_uid_hash="r2"), dict(subject_id=None), dict(subject_id=None, study_uid_hash="other"))
    assert all_of(select_series(rows, small_subjects=True)) == all_of(select_series(rows))


def test_crowded_subjects_are_curated_alike(spark, monkeypatch):
    headers = stage(cohort_instances(spark, SMALL), "test-headers")
    usual = [all_of(df) for df in pipeline.curate_stored(headers)]
    sizes = iv.subject_sizes(headers)
    assert iv.crowded_subjects(sizes).isEmpty() and not iv.crowded_subjects(sizes, 9).isEmpty()
    for rows in (2, 9):  # with and without series that are large by themselves
        monkeypatch.setattr(pipeline, "HOT_ROWS", rows)
        assert [all_of(df) for df in pipeline.curate_stored(headers)] == usual


def test_series_as_json_take_a_small_part_of_their_room(spark):
    path = queries_io._series_arrays(spark, SMALL, "gzip")
    plain = queries_io._series_arrays(spark, SMALL)
    rows = [sorted(map(str, queries_io.readers.read_series_json(spark, f"{p}/*")[0].collect())) for p in (path, plain)]
    assert rows[0] == rows[1] and rows[0]
    packed, whole = (sum(f.stat().st_size for f in Path(p).rglob("part-*")) for p in (path, plain))
    assert packed < whole / 5
    made = queries_work.json_roundtrip(spark, SMALL)
    assert made.count() == len(rows[0]) and all(f.endswith(".json.gz") for f in made.inputFiles())


def test_lines_move_without_what_follows_from_their_order(spark):
    lines = cohort._labelled_lines(spark, SMALL, 5)
    plan = lines._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line)
    depth = plan[at].index("RepartitionByExpression")
    moved = "".join(takewhile(lambda line: not line[:depth].strip(" :"), plan[at + 1 :]))
    assert "p_type" in moved and "subject_id" not in moved and "r_name" not in moved
    assert lines.filter(F.col("subject_id") != iv.tx.subject_label(cohort._subject_folder())).isEmpty()


def test_files_meet_only_the_states_that_look_for_them(spark, monkeypatch):
    monkeypatch.setattr(staging, "BUCKET_ROWS", 100)
    plan = plan_of(queries_work.resume_decisions(spark, SMALL))
    assert plan.count("explode([out/,side/])") == 1  # files move once, not once for every kind
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\), (?:REPARTITION|ENSURE)", plan)]
    assert tasks and min(tasks) > 10


@pytest.mark.parametrize("query", [queries_work.public_inventory, queries_io.results_sink])
def test_tables_of_series_as_tsv_take_a_small_part_of_their_room(spark, query):
    made = query(spark, SMALL)
    assert made.count() > 0 and all(f.endswith(".csv.gz") for f in made.inputFiles())


def test_a_delivery_leaves_nothing_but_the_store(spark, instances, tmp_path):
    before = set(staging._made.get(spark.sparkContext.applicationId, []))
    for at in (0, 1):
        incremental.update(spark, str(tmp_path), instances(*slices(f"P00{at}"), *slices("P009")), at)
    assert set(staging._made.get(spark.sparkContext.applicationId, [])) <= before
    assert incremental.series(spark, str(tmp_path), 1).count() == 3


def test_deliveries_dealt_by_subject_meet_their_store_without_an_exchange(spark, tmp_path):
    n = 4
    headers = stage_bucketed(cohort_instances(spark, SMALL, n), "test-arrivals", ["subject_id"], n, dealt=True)
    order = F.crc32(F.col("relpath").cast("binary")) % 2
    for at in (0, 1):
        incremental.update(spark, str(tmp_path), headers.filter(order == at), at, n)
    assert all_of(incremental.series(spark, str(tmp_path), 1)) == all_of(iv.series_rollup(headers.drop("subject_id")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with incremental._opened(spark, str(tmp_path), n) as store:
            known = store.rows("copies", 0, 1).groupBy(*incremental.COPY_KEYS).agg(F.min("walk"))
            again = incremental.rolled_up(incremental._copies(incremental._keyed(store.rows("headers", 0, 1))))
            for plan in (known, again, known.join(store.rows("states", 1, 1), iv.GROUP_KEYS)):
                assert "Exchange" not in plan_of(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_headers_stored_by_subject_do_not_move(spark):
    n = 5
    rows = cohort_instances(spark, SMALL, n)
    headers = stage_bucketed(rows, "test-dealt", ["subject_id"], n, dealt=True)
    assert all_of(headers.drop("subject_id")) == all_of(cohort_instances(spark, SMALL))
    inside = iv.path_parts(headers).filter("depth >= 3")
    assert inside.filter(F.col("subject_id") != iv.tx.subject_label(F.col("subject_folder"))).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Exchange" not in plan_of(iv.inventory(headers, hot_rows=None, buckets=n, dealt=True))
        assert "Exchange" not in plan_of(iv.subject_sizes(headers, dealt=True))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [all_of(df) for df in pipeline.curate_stored(headers.drop("subject_id"))]
    assert [all_of(df) for df in pipeline.curate_stored(headers, dealt=n)] == moved


def test_buckets_grow_in_number_with_the_headers(spark, monkeypatch):
    headers = stage(cohort_instances(spark, SMALL), "test-headers")
    usual = [all_of(df) for df in pipeline.curate_stored(headers)]
    monkeypatch.setattr(staging, "BUCKET_ROWS", 500)
    tables = pipeline.curate_stored(headers)
    for df in tables:
        name = staging._tables[next(p for p in staging._tables if p.rsplit("/", 1)[1] in df.inputFiles()[0])]
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
        assert int(described["Num Buckets"]) > 10
    assert [all_of(df) for df in tables] == usual


def test_a_bucketed_write_does_not_sort_what_lies_in_buckets(spark):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    written = stage_bucketed(spark.range(1000).repartition(4, "id"), "test-dealt", ["id"], 4, dealt=True)
    assert written.count() == 1000 and len(written.inputFiles()) == 4
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before


def test_marked_subjects_are_the_crowded_and_the_unusable(spark, instances):
    df = instances(*slices(), *slices(center="siteB"), *slices("P002"), dict(relpath="siteA/__/s/1.dcm"))
    found = {r.subject_id: (r.crowded, r.unusable) for r in iv.marked_subjects(iv.subject_sizes(df), 1 << 20).collect()}
    assert found == {"p001": (False, True), None: (False, True)}
    rows = iv.marked_subjects(iv.subject_sizes(df), 2).collect()
    assert {r.subject_id for r in rows if r.crowded} == {r.subject_id for r in iv.crowded_subjects(iv.subject_sizes(df), 2).collect()}


def test_a_roll_up_of_dealt_headers_sorts_once(spark):
    headers = stage_bucketed(cohort_instances(spark, SMALL, 5), "test-dealt", ["subject_id"], 5, dealt=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(iv.inventory(headers, hot_rows=None, buckets=5, dealt=True))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"\bSort \[", plan)) == 1


def test_copies_that_are_equal_in_all_count_once(spark, instances):
    frames = dict(frame_iops=[[1.0, 0.0, 0.0, 0.0, 1.0, 0.0]] * 2, frame_ipps=[[0.0, 0.0, 1.0], [0.0, 0.0, 9.0]])
    df = instances(*slices(**frames))
    rows = [
        {(r.series_uid_hash, r.instance_count, r.duplicate_instance_count, r.coverage_mm) for r in found.collect()}
        for found in (iv.series_rollup(df, hot_rows=None), iv.series_rollup(df.union(df), hot_rows=None), iv.series_rollup(df.union(df), hot_rows=1))
    ]
    n = df.count()
    assert {(r[1], r[2]) for r in rows[0]} == {(n, 0)} and {(r[1], r[2]) for r in rows[1]} == {(n, n)}
    assert rows[1] == rows[2] and {r[3] for r in rows[0]} == {r[3] for r in rows[1]}


def test_a_query_of_series_makes_no_selection(spark):
    staging.release(spark, "selection")
    queries._curated.clear()
    queries.QUERIES["series_scores"](spark, SMALL).count()
    made = [p.rsplit("/", 1)[1] for p in staging._made[spark.sparkContext.applicationId]]
    assert not [p for p in made if p.startswith("selection-")]
    queries.QUERIES["both_modalities"](spark, SMALL).count()
    queries.QUERIES["decision_counts"](spark, SMALL).count()
    made = [p.rsplit("/", 1)[1] for p in staging._made[spark.sparkContext.applicationId]]
    assert len([p for p in made if p.startswith("selection-")]) == 1


def test_paths_are_made_once_and_keys_in_one_step(spark):
    headers, n = dealt_instances(spark, SMALL)
    assert all_of(headers.drop("subject_id")) == all_of(cohort_instances(spark, SMALL))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(iv.inventory(headers, hot_rows=None, buckets=n, dealt=True))
        assert "lpad" not in plan + plan_of(iv.subject_sizes(headers, dealt=True))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Below the unfolding: the headers, and one step for all keys, attributes and planes.
    assert len(re.findall(r"Project \[", plan[plan.index("Generate posexplode"):])) == 2
