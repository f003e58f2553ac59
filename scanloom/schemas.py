"""Schemas of the curated tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

INSTANCES = """
relpath STRING, readable BOOLEAN, modality STRING,
study_uid STRING, series_uid STRING, sop_uid STRING, series_number INT,
series_description STRING, protocol_name STRING, sequence_name STRING, image_type ARRAY<STRING>,
manufacturer STRING, model_name STRING, software_versions STRING, acquisition_type STRING,
repetition_time_ms DOUBLE, echo_time_ms DOUBLE, inversion_time_ms DOUBLE, flip_angle_deg DOUBLE,
`rows` INT, `columns` INT, pixel_spacing ARRAY<DOUBLE>,
slice_thickness_mm DOUBLE, spacing_between_slices_mm DOUBLE,
iop ARRAY<DOUBLE>, ipp ARRAY<DOUBLE>,
frame_iops ARRAY<ARRAY<DOUBLE>>, frame_ipps ARRAY<ARRAY<DOUBLE>>
"""

# One series as stored; the list of its files lives in a table of its own (SERIES_SOURCES).
SERIES = """
center STRING, subject_id STRING, study_uid_hash STRING, series_uid_hash STRING,
series_number INT, modality STRING, series_description STRING, protocol_name STRING,
sequence_name STRING, image_type ARRAY<STRING>, manufacturer STRING, model_name STRING,
software_versions STRING, acquisition_type STRING, repetition_time_ms DOUBLE,
echo_time_ms DOUBLE, inversion_time_ms DOUBLE, flip_angle_deg DOUBLE, `rows` INT, `columns` INT,
pixel_spacing_mm ARRAY<DOUBLE>, slice_thickness_mm DOUBLE, spacing_between_slices_mm DOUBLE,
image_orientation_patient ARRAY<DOUBLE>, nearest_plane STRING, plane STRING,
plane_angle_deg DOUBLE, orientation_consistent BOOLEAN, coverage_mm DOUBLE,
source_kind STRING, candidate_type STRING, classification_confidence STRING, protocol_id STRING,
instance_count BIGINT, duplicate_instance_count BIGINT, inventory_note STRING
"""

SERIES_SOURCES = """
center STRING, subject_id STRING, study_uid_hash STRING, series_uid_hash STRING,
source_relpath STRING
"""

SELECTION = """
center STRING, subject_id STRING, study_uid_hash STRING, series_uid_hash STRING,
candidate_type STRING, decision_status STRING, score DOUBLE, reason STRING,
source_plane STRING, source_kind STRING, protocol_id STRING, output_basename STRING,
reviewer STRING, manual_decision STRING
"""

RESULTS = """
subject_id STRING, series_uid_hash STRING, candidate_type STRING, status STRING, mode STRING,
output_path STRING, message STRING, output_sha256 STRING, sidecar_path STRING,
sidecar_sha256 STRING, worker_pid BIGINT, child_pid BIGINT, started_at STRING,
finished_at STRING, elapsed_seconds DOUBLE, log_path STRING
"""

PILOT = """
subject_id STRING, center STRING, reason STRING, stratum STRING, protocol_id STRING,
stratum_available BIGINT, stratum_target INT, shortfall BIGINT
"""

CATALOG = """
protocol_id STRING, candidate_type STRING, manufacturer STRING, model_name STRING,
software_versions STRING, acquisition_type STRING, repetition_time_ms DOUBLE,
echo_time_ms DOUBLE, inversion_time_ms DOUBLE, slice_thickness_mm DOUBLE,
pixel_spacing_mm STRING, series_count BIGINT, subject_count BIGINT, centers STRING
"""

MANUAL_REVIEW = """
center STRING, subject_id STRING, study_uid_hash STRING, series_uid_hash STRING,
candidate_type STRING, series_description STRING, protocol_name STRING, source_plane STRING,
plane_angle_deg DOUBLE, source_kind STRING, protocol_id STRING, score STRING, reason STRING,
decision STRING, reviewer STRING, comments STRING
"""

QC = """
subject_id STRING, series_uid_hash STRING, candidate_type STRING, status STRING, detail STRING,
nifti STRING, montage STRING, registration_metric STRING
"""

ASSET_DIFF = """
subject_id STRING, modality STRING, action STRING, old_path STRING, old_sha256 STRING,
new_path STRING, series_uid_hash STRING, reason STRING
"""

LIFECYCLE_EVENTS = """
series_uid_hash STRING, stage STRING, ts TIMESTAMP, worker_id STRING, subject_id STRING,
candidate_type STRING, attrs MAP<STRING, STRING>
"""


def columns(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).fieldNames()


SERIES_KEYS = ["center", "subject_id", "study_uid_hash", "series_uid_hash"]
