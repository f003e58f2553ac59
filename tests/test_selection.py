import random

import pytest
from pyspark.sql import functions as F

from scanloom.operators import review as rv
from scanloom.operators.catalog import protocol_catalog
from scanloom.operators.inventory import inventory
from scanloom.operators.pilot import pilot_totals, select_pilot
from scanloom.operators.selection import both_modalities, scored, select_series
from scanloom.params import PilotParams, SelectionParams
from scanloom.plans.cohort import cohort_instances


def outcome(df, params=SelectionParams()):
    return {r.series_uid_hash: (r.decision_status, r.reason) for r in select_series(df, params).collect()}


FLAIR = dict(candidate_type="flair", series_description="FLAIR", protocol_name="")


def test_original_beats_reformat(series):
    got = outcome(series(dict(series_uid_hash="a"), dict(series_uid_hash="b", source_kind="derived_mpr")))
    assert got == {"a": ("selected", "best_original_axial_t1"), "b": ("excluded", "lower_ranked_t1")}


def test_reformat_is_the_fallback(series):
    df = series(dict(series_uid_hash="a", plane="sagittal"), dict(series_uid_hash="b", source_kind="derived_mpr"))
    assert outcome(df)["b"] == ("selected", "axial_mpr_fallback")
    off = SelectionParams(allow_axial_mpr_fallback=False)
    assert set(outcome(df, off).values()) == {("review", "no_reliable_axial_t1")}
    names = {r.output_basename for r in select_series(df).collect()}
    assert names == {"", "sub-000_rec-axialmpr_T1w"}


def test_t1_tie_takes_everyone_within_the_margin(series):
    got = outcome(series(
        dict(series_uid_hash="a", coverage_mm=125.0), dict(series_uid_hash="b", coverage_mm=120.0),
        dict(series_uid_hash="c", coverage_mm=100.0), dict(series_uid_hash="d", coverage_mm=99.0),
        dict(series_uid_hash="e", plane="coronal", coverage_mm=125.0),
    ))
    tie, low = ("review", "t1_near_tie"), ("excluded", "lower_ranked_t1")
    assert got == {"a": tie, "b": tie, "c": tie, "d": low, "e": low}


def test_flair_tie_takes_only_two(series):
    got = outcome(series(*[dict(FLAIR, series_uid_hash=h) for h in "abc"]))
    assert got["a"] == got["b"] == ("review", "flair_near_tie")
    assert got["c"] == ("excluded", "lower_ranked_flair")


def test_flair_confidence_is_asked_before_the_tie(series):
    weak = dict(FLAIR, classification_confidence="medium", acquisition_type="3D")
    got = outcome(series(dict(weak, series_uid_hash="a"), dict(FLAIR, series_uid_hash="b")))
    assert got == {"a": ("review", "flair_low_confidence"), "b": ("excluded", "lower_ranked_flair")}


def test_3d_preferred_and_motion_penalised(series):
    got = outcome(series(dict(FLAIR, series_uid_hash="a"), dict(FLAIR, series_uid_hash="b", acquisition_type="3D")))
    assert got["b"] == ("selected", "best_wmh_flair")
    df = series(dict(FLAIR, series_uid_hash="a"), dict(FLAIR, series_uid_hash="b", series_description="FLAIR motion"))
    score = {r.series_uid_hash: r.score for r in scored(df).collect()}
    assert score["a"] - score["b"] == 40.0


def test_nan_coverage_is_not_wide_enough(series):
    df = series(dict(FLAIR, series_uid_hash="a", coverage_mm=float("nan")), dict(FLAIR, series_uid_hash="b", coverage_mm=50.0))
    assert len({r.score for r in scored(df).collect()}) == 1


def test_multiple_studies_and_other(series):
    got = outcome(series(
        dict(series_uid_hash="a"), dict(series_uid_hash="b", study_uid_hash="x"),
        dict(series_uid_hash="c", candidate_type="other"),
    ))
    assert got["a"] == got["b"] == ("review", "multiple_studies")
    assert got["c"] == ("excluded", "not_t1_or_flair")


def random_subjects():
    rng, rows = random.Random(7), []
    for s in range(60):
        for n in range(rng.randint(1, 7)):
            flair = rng.random() < 0.5
            rows.append(dict(
                FLAIR if flair else {}, subject_id=f"s{s}", series_uid_hash=f"h{s}-{n}",
                plane=rng.choice(["axial", "axial", "sagittal"]),
                source_kind=rng.choice(["original", "derived_mpr", "unknown"]),
                coverage_mm=rng.choice([None, 80.0, 100.0, 125.0, 150.0]),
                acquisition_type=rng.choice(["2D", "3D"]),
                classification_confidence=rng.choice(["high", "high", "medium"]),
                orientation_consistent=rng.random() < 0.9,
            ))
    return rows


def test_random_subjects_obey_the_rules(series):
    """What must hold for any subject, told without repeating how it is decided."""
    df = series(*random_subjects())
    facts = {r.series_uid_hash: r for r in scored(df).collect()}
    groups = {}
    for r in select_series(df).collect():
        groups.setdefault((r.subject_id, r.candidate_type), []).append(r)
    assert sum(map(len, groups.values())) == len(facts)
    for (_, kind), rows in groups.items():
        status = [r.decision_status for r in rows]
        assert status.count("selected") <= 1
        assert not ("selected" in status and "review" in status)
        best = max(facts[r.series_uid_hash].score for r in rows)
        for r in rows:
            fact = facts[r.series_uid_hash]
            assert (r.output_basename != "") == (r.decision_status == "selected")
            if kind == "flair" and r.decision_status != "excluded":
                assert best - fact.score <= 5.0
            if kind == "t1" and r.decision_status == "selected":
                assert fact.plane == "axial" and fact.source_kind in ("original", "derived_mpr")
            if r.reason.endswith("near_tie"):
                assert sum(x.reason == r.reason for x in rows) > 1
        tied = [facts[r.series_uid_hash].score for r in rows if r.reason == "t1_near_tie"]
        assert not tied or max(tied) - min(tied) <= 5.0


def test_decisions_do_not_depend_on_row_order(series):
    rows = random_subjects()
    first = outcome(series(*rows))
    random.Random(8).shuffle(rows)
    assert outcome(series(*rows).repartition(5)) == first


def test_one_selected_per_subject_and_type(spark):
    series = inventory(cohort_instances(spark, "/root/testdata/sf0.001")).cache()
    chosen = select_series(series).cache()
    assert chosen.count() == series.count()
    twice = chosen.filter("decision_status = 'selected'").groupBy("subject_id", "candidate_type").count()
    assert twice.filter("count > 1").count() == 0


def sheet(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "position INT, subject_id STRING, study_uid_hash STRING, series_uid_hash STRING, decision STRING, reviewer STRING",
    )


def test_manual_acceptance_supersedes(spark, selection):
    rows = selection(
        dict(series_uid_hash="a"), dict(series_uid_hash="b", decision_status="review", source_plane="sagittal"),
        dict(series_uid_hash="c", study_uid_hash="other", decision_status="review"),
    )
    s = sheet(spark, ("000", "visit", "b", "exclude", "x"), ("000", " visit ", "b", " accept_sag_fallback ", "me"))
    got = {r.series_uid_hash: r for r in rv.apply_manual_decisions(rows, s).collect()}
    assert (got["b"].reason, got["b"].output_basename, got["b"].reviewer) == (
        "manual_accept_sag_fallback", "sub-000_acq-manualsag_T1w", "me")
    assert got["a"].reason == got["c"].reason == "superseded_by_manual_selection"
    assert rv.decision_violations(rows, s).count() == 0


def test_violations(spark, selection):
    rows = selection(dict(series_uid_hash="a"), dict(series_uid_hash="b"))
    bad = sheet(spark, ("000", "visit", "a", "maybe", ""), ("000", "visit", "b", "accept_flair", ""))
    problems = rv.decision_violations(rows, bad)
    assert {r.problem for r in problems.collect()} == {
        "invalid manual decision: 'maybe'", "accept_flair may only be used for FLAIR candidates"}
    with pytest.raises(ValueError):
        rv.assert_no_violations(problems)
    with pytest.raises(ValueError, match="maybe"):
        rv.apply_manual_decisions(rows, bad)
    left = rv.apply_manual_decisions(rows, bad, on_problem="leave")
    assert left.exceptAll(rows).count() == 0 and left.count() == 2
    two = sheet(spark, ("000", "visit", "a", "accept_original", ""), ("000", "visit", "b", "accept_original", ""))
    assert "multiple manually accepted" in rv.decision_violations(rows, two).first().problem
    with pytest.raises(ValueError, match="multiple"):
        rv.apply_manual_decisions(rows, two)
    assert rv.apply_manual_decisions(rows, two, on_problem="leave").exceptAll(rows).count() == 0


def test_review_sheet_keeps_human_columns(spark, selection, series):
    rows = selection(dict(decision_status="review", reason="t1_near_tie"))
    prior = spark.createDataFrame(
        [(1, "000", "visit", "run", "exclude", "me", "why")],
        "position INT, subject_id STRING, study_uid_hash STRING, series_uid_hash STRING, decision STRING, reviewer STRING, comments STRING")
    row = rv.review_sheet(rows, series({}), prior).first()
    assert (row.decision, row.reviewer, row.comments, row.score) == ("exclude", "me", "why", "72.500000")


def test_pilot(series, selection):
    facts, chosen = [], []
    for n, protocol in (("000", "usual"), ("002", "usual"), ("003", "usual"), ("004", "odd")):
        facts += [dict(subject_id=n, series_uid_hash=f"t{n}"),
                  dict(FLAIR, subject_id=n, series_uid_hash=f"f{n}", protocol_id=protocol, manufacturer="M")]
        chosen += [dict(subject_id=n, series_uid_hash=f"t{n}"),
                   dict(subject_id=n, series_uid_hash=f"f{n}", candidate_type="flair")]
    facts.append(dict(subject_id="005", series_uid_hash="t005", plane="unknown"))
    chosen.append(dict(subject_id="005", series_uid_hash="t005", decision_status="review"))
    got = select_pilot(selection(*chosen), series(*facts), PilotParams(2)).collect()
    assert {(r.subject_id, r.reason, r.stratum_available, r.shortfall) for r in got} == {
        ("000", "flair_protocol_stratum", 3, 0), ("002", "flair_protocol_stratum", 3, 0),
        ("004", "flair_protocol_stratum", 1, 1), ("005", "review_or_low_confidence", 1, 1)}
    assert {r.stratum for r in got if r.subject_id == "004"} == {"site07|M|Alpha|odd"}
    totals = pilot_totals(select_pilot(selection(*chosen), series(*facts))).first()
    assert tuple(totals) == (4, 2, 1)
    assert {r.subject_id for r in both_modalities(selection(*chosen)).collect()} == {"000", "002", "003", "004"}


def test_catalog(series):
    row = protocol_catalog(series(
        dict(series_uid_hash="b", series_number=2, manufacturer="later"),
        dict(series_uid_hash="a", series_number=1, manufacturer="first"),
        dict(center="site00", subject_id="009", series_uid_hash="c", manufacturer="x"),
    )).first()
    assert (row.manufacturer, row.series_count, row.subject_count, row.centers) == ("x", 3, 2, "site00;site07")


def test_params_are_checked():
    for bad in (dict(axial_max_angle_deg=45.0), dict(orientation_consistency_deg=0.0)):
        with pytest.raises(ValueError):
            SelectionParams(**bad)
    with pytest.raises(ValueError):
        PilotParams(0)


def test_a_series_missing_from_the_inventory_is_refused(spark, series, selection):
    from scanloom.operators import qc

    rows = selection(dict(decision_status="review"), dict(series_uid_hash="gone", decision_status="review", subject_id="009"))
    with pytest.raises(ValueError, match="sub-009 gone"):
        rv.review_sheet(rows, series({}))
    left = {r.series_uid_hash: r.series_description for r in rv.review_sheet(rows, series({}), on_missing="leave").collect()}
    assert left["gone"] is None and left["run"] is not None
    chosen = selection(dict(series_uid_hash="gone", decision_status="selected"))
    headers = spark.createDataFrame([], "nifti STRING, exists BOOLEAN, read_error STRING, dims ARRAY<INT>, affine ARRAY<ARRAY<DOUBLE>>, zooms ARRAY<DOUBLE>, qform_code INT, sform_code INT")
    with pytest.raises(ValueError, match="gone"):
        qc.qc_summary(chosen, headers, "/out", series=series({}))
    only = spark.createDataFrame([("sub-000",)], "subject_id STRING")
    both = selection(dict(decision_status="review"), dict(decision_status="review", subject_id="x1"))
    assert [r.subject_id for r in qc.qc_summary(both, headers, "/out", subjects=only).collect()] == ["000"]


def test_curated_tables_are_joined_without_an_exchange_of_them(spark, series, selection):
    from scanloom.operators.staging import stage_bucketed

    facts = stage_bucketed(series({}, dict(subject_id="2")), "test-series", ["subject_id"], 4)
    rows = stage_bucketed(selection(dict(decision_status="review"), dict(subject_id="2", decision_status="review")), "test-rows", ["subject_id"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for joined in (rv.series_lookup(rows, facts, ["plane"], "left"), rv.missing_series(rows, facts)):
            assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rv.series_lookup(rows, facts, ["plane"], "left").count() == 2
