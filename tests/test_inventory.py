import pytest
from pyspark.sql import functions as F

from scanloom.operators import inventory as iv
from scanloom.plans.cohort import cohort_instances
from scanloom.plans.pipeline import curate

SMALL = "/root/testdata/sf0.001"


def slices(subject="P001", center="siteA", n=3, **more):
    return [
        dict(relpath=f"{center}/{subject}/series/{i}.dcm", sop_uid=f"1.{i}", ipp=[0.0, 0.0, 5.0 * i],
             **more)
        for i in range(n)
    ]


def test_three_slices_make_one_axial_t1(instances):
    row = iv.inventory(instances(*slices())).collect()
    assert len(row) == 1
    row = row[0]
    assert (row.instance_count, row.plane, row.coverage_mm) == (3, "axial", 14.0)
    assert (row.candidate_type, row.subject_id, row.inventory_note) == ("t1", "p001", "")


def test_duplicates_and_counts(instances):
    rows = []
    for subject in ("P001", "P002"):
        one = dict(relpath=f"siteA/{subject}/s/1.dcm", sop_uid="1.1", ipp=[0.0, 0.0, 0.0])
        rows += [one, {**one, "relpath": f"siteA/{subject}/s/2.dcm"}]
    df = instances(*rows)
    found = iv.series_rollup(df).select("instance_count", "duplicate_instance_count").collect()
    assert [tuple(r) for r in found] == [(1, 1), (1, 1)]
    assert tuple(iv.inventory_counts(df).first()) == (4, 0)
    assert iv.series_sources(df).count() == 2


def test_a_copy_does_not_lend_its_geometry(instances):
    kept = dict(relpath="a/S1/s/1.dcm", sop_uid="1", iop=None, ipp=None)
    copy = dict(relpath="a/S1/s/2.dcm", sop_uid="1", ipp=[0.0, 0.0, 9.0])
    for hot in (None, 1):
        row = iv.series_rollup(instances(kept, copy), hot_rows=hot).first()
        assert (row.plane, row.coverage_mm, row.inventory_note) == ("unknown", None, "missing_orientation")


def test_invalid_representative_but_valid_reference(instances):
    first = dict(relpath="a/S1/s/1.dcm", sop_uid="1", iop=[0.0] * 6, ipp=[0.0, 0.0, 0.0])
    second = dict(relpath="a/S1/s/2.dcm", sop_uid="2", ipp=[0.0, 0.0, 5.0])
    third = dict(relpath="a/S1/s/3.dcm", sop_uid="3", iop=[0.0, 1.0, 0.0, 0.0, 0.0, -1.0])
    row = iv.series_rollup(instances(first, second, third)).first()
    assert (row.nearest_plane, row.plane, row.coverage_mm) == ("unknown", "inconsistent", None)
    assert row.inventory_note == "orientation_deviation=90.000"


def test_multi_frame_vectors_count(instances):
    row = dict(relpath="a/S1/s/1.dcm", sop_uid="1", iop=None, ipp=None,
               frame_iops=[[1.0, 0.0, 0.0, 0.0, 1.0, 0.0]],
               frame_ipps=[[0.0, 0.0, 0.0], [0.0, 0.0, 30.0], [1.0]])
    found = iv.series_rollup(instances(row)).first()
    assert (found.plane, found.coverage_mm, found.instance_count) == ("axial", 34.0, 1)


def test_unreadable_routing(instances):
    df = instances(
        dict(relpath="top.dcm"), dict(relpath="a/x.dcm"), dict(relpath="a/S1/1", readable=False),
        dict(relpath="a/S1/2", modality=""), dict(relpath="a/S1/3", sop_uid="3"),
    )
    lost = {r.source_relpath for r in iv.unreadable(df).collect()}
    assert lost == {"top.dcm", "a/x.dcm", "a/S1/1", "a/S1/2"}
    assert iv.series_rollup(df).count() == 1


def test_missing_identifiers_fall_back_to_places(instances):
    df = instances(
        dict(relpath="a/S1/x/1", sop_uid=None, study_uid=None, series_uid=""),
        dict(relpath="a/S1/x/2", sop_uid=None, study_uid="", series_uid=None),
        dict(relpath="a/S1/y/1", sop_uid=None, study_uid=None, series_uid=None),
    )
    import hashlib

    got = {(r.study_uid_hash, r.series_uid_hash, r.instance_count) for r in iv.series_rollup(df).collect()}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    study = h("missing-study:a/s1")
    assert got == {(study, h("missing-series:a/S1/x"), 2), (study, h("missing-series:a/S1/y"), 1)}


def test_collisions_are_reported(instances):
    df = instances(*slices(), *slices(center="siteB"))
    found = iv.center_collisions(iv.subject_dirs(df))
    assert [tuple(r) for r in found.collect()] == [("p001", "siteA;siteB", 2)]
    with pytest.raises(ValueError, match="sub-p001"):
        curate(df)
    more = instances(*[r for i in range(25) for c in "AB" for r in slices(f"X{i}", f"site{c}", 1)])
    with pytest.raises(ValueError, match="and 5 more"):
        iv.raise_problems(iv.subject_problems(more))


def test_reported_subjects_are_left_out(instances):
    df = instances(*slices(), *slices(center="siteB"), *slices("P002"), dict(relpath="siteA/__/s/1.dcm"), dict(relpath="top.dcm"))
    series, chosen, problems = curate(df, on_problem="report")
    assert [r.subject_id for r in series.collect()] == ["p002"] and chosen.count() == 1
    assert sorted(r.subject_id or "" for r in problems.collect()) == ["", "p001"]
    with pytest.raises(ValueError, match="does not produce"):
        curate(instances(dict(relpath="siteA/__/s/1.dcm")))


def test_invalid_folder_is_a_problem(instances):
    assert iv.invalid_subject_folders(instances(dict(relpath="a/__/s/1"))).count() == 1


def test_hot_path_equals_usual_path(spark):
    df = cohort_instances(spark, SMALL)
    usual = iv.inventory(df, hot_rows=None)
    for hot in (1, 3):
        spread = iv.inventory(df, hot_rows=hot)
        assert usual.exceptAll(spread).count() == 0 and spread.exceptAll(usual).count() == 0


def test_both_paths_agree_on_doubled_rows_null_labels_and_frames(instances):
    one = dict(relpath="a/S1/s/1.dcm", sop_uid="1", ipp=[0.0, 0.0, 0.0])
    frames = dict(relpath="a/S2/s/1.dcm", sop_uid="1", iop=None, ipp=None, frame_iops=[[1.0, 0.0, 0.0, 0.0, 1.0, 0.0]] * 3,
                  frame_ipps=[[0.0, 0.0, 4.0 * i] for i in range(3)])
    df = instances(
        one, one, {**one, "manufacturer": "Other", "ipp": [0.0, 0.0, 9.0]}, {**one, "sop_uid": "2", "relpath": "a/S1/s/2.dcm"},
        *slices("__"), dict(relpath="a/__/x/7.dcm", study_uid=None, series_uid=None, sop_uid=None), frames, frames,
    )
    tables = [iv.series_rollup(df, hot_rows=hot).collect() for hot in (None, 1, 3)]
    assert sorted(map(str, tables[0])) == sorted(map(str, tables[1])) == sorted(map(str, tables[2]))
    counts = {(r.subject_id, r.instance_count, r.duplicate_instance_count) for r in tables[0]}
    assert counts == {("s1", 2, 2), (None, 3, 0), (None, 1, 0), ("s2", 1, 1)}


def test_result_does_not_depend_on_partitioning(spark):
    df = cohort_instances(spark, SMALL)
    a, b = iv.inventory(df), iv.inventory(df.repartition(13, F.rand(1)).cache())
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_usual_path_shuffles_headers_once(spark, instances):
    plan = iv.series_rollup(instances(*slices()), hot_rows=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
