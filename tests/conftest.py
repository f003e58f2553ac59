import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from scanloom.schemas import INSTANCES, SELECTION, SERIES  # noqa: E402
from scanloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


def _rows(spark, ddl, default, overrides):
    names = spark.createDataFrame([], ddl).columns
    rows = [tuple({**default, **o}.get(n) for n in names) for o in overrides]
    return spark.createDataFrame(rows, ddl)


SERIES_DEFAULT = dict(
    center="site07", subject_id="000", study_uid_hash="visit", series_uid_hash="run",
    modality="MR", series_description="tra t1 gre", protocol_name="brain", sequence_name="gre",
    image_type=["ORIGINAL", "PRIMARY", "NORM"], manufacturer="", model_name="Alpha",
    software_versions="v5", acquisition_type="2D", pixel_spacing_mm=[0.8, 0.8],
    slice_thickness_mm=1.5, spacing_between_slices_mm=1.5, image_orientation_patient=[],
    nearest_plane="axial", plane="axial", plane_angle_deg=1.25, orientation_consistent=True,
    coverage_mm=141.0, source_kind="original", candidate_type="t1",
    classification_confidence="high", protocol_id="p-default", instance_count=94,
    duplicate_instance_count=0, inventory_note="",
)
SELECTION_DEFAULT = dict(
    center="site07", subject_id="000", study_uid_hash="visit", series_uid_hash="run",
    candidate_type="t1", decision_status="selected", score=72.5, reason="best_original_axial_t1",
    source_plane="axial", source_kind="original", protocol_id="p-default",
    output_basename="sub-000_T1w", reviewer="", manual_decision="",
)
INSTANCE_DEFAULT = dict(
    readable=True, modality="MR", study_uid="9.1", series_uid="9.1.4", series_number=6,
    series_description="tra t1 gre", protocol_name="", image_type=["ORIGINAL", "PRIMARY", "NORM"],
    manufacturer="Maker", model_name="Alpha", acquisition_type="2D", repetition_time_ms=620.0,
    echo_time_ms=14.0, rows=64, columns=48, pixel_spacing=[0.8, 0.8], slice_thickness_mm=4.0,
    spacing_between_slices_mm=4.0, iop=[1.0, 0.0, 0.0, 0.0, 1.0, 0.0],
)


@pytest.fixture
def series(spark):
    return lambda *rows: _rows(spark, SERIES, SERIES_DEFAULT, rows)


@pytest.fixture
def selection(spark):
    return lambda *rows: _rows(spark, SELECTION, SELECTION_DEFAULT, rows)


@pytest.fixture
def instances(spark):
    return lambda *rows: _rows(spark, INSTANCES, INSTANCE_DEFAULT, rows)
