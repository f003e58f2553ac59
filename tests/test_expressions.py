import math

import pytest
from pyspark.sql import functions as F

from scanloom.functions import text as tx
from scanloom.functions.geometry import add_plane, add_slice_normal, determinant3, voxel_volume
from scanloom.functions.scoring import candidate, series_text, source_kind
from scanloom.operators.inventory import classify


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, label",
    [("Sub 7/B.x", "7bx"), ("SUBSUB9", "sub9"), ("sub", "sub"), ("__", None)],
)
def test_subject_label(spark, raw, label):
    assert one(spark, tx.subject_label(F.lit(raw))) == label


def test_walk_order_puts_files_before_folders(spark):
    paths = ["c/s/b.dcm", "c/s/a/z.dcm", "c/s/a.dcm", "c/s/a-b/y.dcm", "c/t.dcm", "top"]
    df = spark.createDataFrame([(p,) for p in paths], "p STRING")
    ordered = [r.p for r in df.orderBy(tx.walk_order_key(F.col("p"))).collect()]
    assert ordered == ["top", "c/t.dcm", "c/s/a.dcm", "c/s/b.dcm", "c/s/a/z.dcm", "c/s/a-b/y.dcm"]


def test_walk_order_matches_a_real_walk(spark, tmp_path):
    import os

    for name in ["a/1", "a/b/2", "a/b-c/3", "a/B/4", "b", "a.x/5", "a/b/d/6"]:
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x")
    walked = []
    for folder, folders, files in os.walk(tmp_path):
        folders.sort()
        walked += [os.path.relpath(os.path.join(folder, f), tmp_path) for f in sorted(files)]
    df = spark.createDataFrame([(p,) for p in reversed(walked)], "p STRING")
    assert [r.p for r in df.orderBy(tx.walk_order_key(F.col("p"))).collect()] == walked


@pytest.mark.parametrize(
    "x, text",
    [(1.0, "1"), (0.96, "0.96"), (-0.28, "-0.28"), (1e-5, "1e-05"), (0.1234567891, "0.12345679"),
     (123456789.0, "1.2345679e+08"), (0.0, "0"), (100.0, "100"), (-1.0, "-1")],
)
def test_general_8_matches_printf(spark, x, text):
    assert f"{x:.8g}" == text
    assert one(spark, tx.general_8(F.lit(x))) == text


@pytest.mark.parametrize(
    "line, percent",
    [("done 45%", 45), ("1234%", None), ("150% x", 100), ("a 7% b 9%", 7), ("none", None)],
)
def test_progress_percent(spark, line, percent):
    assert one(spark, tx.progress_percent(F.lit(line))) == percent


@pytest.mark.parametrize(
    "uid, ok",
    [("1.2.3", True), (" 1.2 ", True), (".1", False), ("1.", False), ("1..2", False), ("", False),
     ("1" * 65, False), ("1a", False)],
)
def test_valid_uid(spark, uid, ok):
    assert one(spark, tx.valid_uid(F.lit(uid))) is ok


def test_coercion(spark):
    assert one(spark, tx.safe_double(F.lit(" 2.5\t"))) == 2.5
    assert one(spark, tx.safe_double(F.lit("2,5"))) is None
    assert one(spark, tx.safe_int(F.lit("3.7"))) is None
    assert one(spark, tx.text_vector(F.lit("1\\2"), 2)) == [1.0, 2.0]
    assert one(spark, tx.text_vector(F.lit("1\\x"), 2)) == []
    assert one(spark, tx.split_values(F.lit("\\A\\\\B"))) == ["A", "B"]
    assert one(spark, tx.strip(F.lit(" \t x y \n"))) == "x y"
    assert one(spark, tx.clean_ascii(F.lit(" é ab "), 16)) == "ab"


def _planes(spark, *vectors, limit=20.0):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i INT, iop ARRAY<DOUBLE>")
    df = add_plane(add_slice_normal(df, "iop", "n"), "n", limit)
    return [(r.plane, r.plane_angle_deg) for r in df.orderBy("i").collect()]


def _tilt(deg):
    a = math.radians(deg)
    return [1.0, 0.0, 0.0, 0.0, math.cos(a), math.sin(a)]


def test_planes(spark):
    found = _planes(
        spark,
        [1.0, 0.0, 0.0, 0.0, 1.0, 0.0],
        [0.0, 1.0, 0.0, 0.0, 0.0, -1.0],
        [1.0, 0.0, 0.0, 0.0, 0.0, -1.0],
        [-1.0, 0.0, 0.0, 0.0, 1.0, 0.0],
        _tilt(10), _tilt(25), _tilt(19.999999),
        [], [0.0] * 6, [1.0, 0.0, 0.0, 2.0, 0.0, 0.0], [float("nan")] + [1.0] * 5,
        [2.0, 0.0, 0.0, 0.0, 3.0, 0.0], [float("inf"), 0.0, 0.0, 0.0, 1.0, 0.0],
    )
    assert [p for p, _ in found] == [
        "axial", "sagittal", "coronal", "axial", "axial", "oblique", "axial",
        "unknown", "unknown", "unknown", "unknown", "axial", "unknown",
    ]
    assert found[4][1] == pytest.approx(10.0)
    assert found[7][1] is None


def test_determinant_and_volume(spark):
    m = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in
                  ([2, 0, 1, 9], [1, 3, 0, 9], [0, 1, 4, 9], [0, 0, 0, 1])])
    assert one(spark, determinant3(m)) == pytest.approx(25.0)
    spacing = F.array(F.lit(0.5), F.lit(0.5))
    assert one(spark, voxel_volume(spacing, F.lit(4.0))) == 1.0
    assert one(spark, voxel_volume(spacing, F.lit(0.0))) is None
    assert one(spark, voxel_volume(F.array(F.lit(0.5)), F.lit(4.0))) is None
    assert one(spark, voxel_volume(spacing, F.lit(float("nan")))) is None


@pytest.mark.parametrize(
    "fields, kind, confidence",
    [
        (dict(series_description="SAG T1W"), "t1", "high"),
        (dict(series_description="cor dark-fluid spc", protocol_name=""), "flair", "high"),
        (dict(series_description="IR", protocol_name="", repetition_time_ms=4700.0,
              echo_time_ms=95.0, inversion_time_ms=1650.0), "flair", "medium"),
        (dict(series_description="scout_T1_3pl"), "other", "high"),
        (dict(series_description="t1 flair", protocol_name=""), "other", "low"),
        (dict(series_description="t1flair", protocol_name="", repetition_time_ms=5000.0,
              echo_time_ms=120.0, inversion_time_ms=1800.0), "flair", "medium"),
        (dict(modality="CT"), "other", "low"),
        (dict(series_description="IR", protocol_name="", repetition_time_ms=float("nan"),
              echo_time_ms=120.0, inversion_time_ms=1800.0), "other", "low"),
    ],
)
def test_candidate(series, fields, kind, confidence):
    row = series(fields).select(candidate(series_text()).alias("v")).first().v
    assert (row.candidate_type, row.classification_confidence) == (kind, confidence)


@pytest.mark.parametrize(
    "fields, kind",
    [
        (dict(), "original"),
        (dict(series_description="T1 MPR"), "derived_mpr"),
        (dict(image_type=["derived", "SECONDARY"]), "derived"),
        (dict(image_type=[]), "unknown"),
    ],
)
def test_source_kind(series, fields, kind):
    assert series(fields).select(source_kind().alias("v")).first().v == kind


def test_protocol_id_keeps_slots_and_trims(series):
    import hashlib

    row = classify(series(dict(
        manufacturer=" ACME ", repetition_time_ms=500.0, model_name="", software_versions="", slice_thickness_mm=1.0,
        spacing_between_slices_mm=1.0, pixel_spacing_mm=[1.0, 1.0],
    ))).first()
    text = "t1|acme|||2D|500.0000||||1.0000|1.0000|1.0000x1.0000"
    assert row.protocol_id == "t1-" + hashlib.sha256(text.encode()).hexdigest()[:10]
    half = series(dict(slice_thickness_mm=2.00005))
    assert classify(half).first().protocol_id != classify(half, True).first().protocol_id


def test_fixed_decimals_are_those_of_the_formatter(spark):
    values = [0.0, -0.0, 1e-9, -1e-5, 0.00005, 0.00015, 1.00005, -2.00005, 2.5, 8000.5, 999999999.99995, 1e9, 1e300,
              float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (3, 4, 6):
        rows = df.select(tx.fixed_decimals(F.col("x"), digits).alias("a"), F.format_string(f"%.{digits}f", "x").alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows]


def test_words_are_told_like_tokens_of_normalised_text(spark):
    words = ("mpr", "reformat", "reformatted")
    texts = ["T1 MPRAGE MPR", "mpr", "T1-mpr_x", "xmpr", "reformatted", "Re format", "MP", "", None, "REFORMAT.", "mpr9"]
    df = spark.createDataFrame([(t, o) for t in texts for o in ("a mpr", "p", None)], "a STRING, b STRING")
    whole = tx.normalize_text(F.col("a"), F.col("b"))
    for row in df.withColumn("t", whole).select(
        tx.has_any_token(whole, words).alias("v"),
        tx.holds_any_token(F.col("t"), words).alias("held"),
        tx.has_any_word([F.col("a"), F.col("b")], words).alias("word"),
    ).collect():
        assert row.v == row.held == row.word
