"""The registered queries: every operator over whole tables, beside plain SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import text as tx
from scanloom.functions.scoring import slice_gap
from scanloom.functions.geometry import voxel_volume
from scanloom.operators import catalog, incremental, inventory, pilot, review, selection
from scanloom.operators.staging import scratch_path, stage
from scanloom.params import PilotParams
from scanloom.plans.cohort import cohort_instances, dealt_instances, stored_instances, table
from scanloom.plans.oracle_base import COHORT, KEYED, SCORES, SELECTION, SERIES, SHEET, query
from scanloom.plans.pipeline import curate, curate_series
from scanloom.schemas import SERIES_KEYS
from scanloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_curated: dict[tuple[str, str], tuple[DataFrame, Callable[[], DataFrame]]] = {}


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _curated:
        headers, buckets = dealt_instances(spark, sf_dir)
        _curated[key] = curate_series(headers, dealt=buckets)
    return _curated[key]


def curated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored series table, made once per application like the headers."""
    return _made(spark, sf_dir)[0]


def curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored series and selection tables; the selection is made for the first query that reads it."""
    series, selection = _made(spark, sf_dir)
    return series, selection()


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


# ---------------------------------------------------------------------------------------------
# Inventory
# ---------------------------------------------------------------------------------------------


@registered(query(COHORT, """
SELECT relpath, readable, modality, study_uid, series_uid, sop_uid, series_number, series_description,
  sequence_name, array_to_string(image_type, '\\') AS image_type, manufacturer, acquisition_type,
  repetition_time_ms, inversion_time_ms, pixel_spacing[1] AS spacing, slice_thickness_mm,
  spacing_between_slices_mm, iop[5] AS iop_5, ipp[3] AS ipp_3, frame_iops[1][5] AS frame_iop_5,
  frame_ipps[2][3] AS frame_ipp_3
FROM cohort"""))
def instance_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_instances(spark, sf_dir).select(
        "relpath", "readable", "modality", "study_uid", "series_uid", "sop_uid", "series_number",
        "series_description", "sequence_name", tx.join_values(F.col("image_type")).alias("image_type"),
        "manufacturer", "acquisition_type", "repetition_time_ms", "inversion_time_ms",
        F.get("pixel_spacing", F.lit(0)).alias("spacing"), "slice_thickness_mm",
        "spacing_between_slices_mm", F.get("iop", F.lit(4)).alias("iop_5"),
        F.get("ipp", F.lit(2)).alias("ipp_3"),
        F.get(F.get("frame_iops", F.lit(0)), F.lit(4)).alias("frame_iop_5"),
        F.get(F.get("frame_ipps", F.lit(1)), F.lit(2)).alias("frame_ipp_3"),
    )


@registered(query(COHORT, """
SELECT relpath,
  CASE WHEN len(coalesce(sequence_name, '')) = 3 THEN NULL ELSE series_number END AS series_number,
  CASE WHEN acquisition_type = '2D' THEN repetition_time_ms END AS repetition_time_ms,
  CASE WHEN ipp IS NOT NULL AND readable THEN len(ipp) ELSE 0 END AS n_ipp,
  CASE WHEN ipp IS NOT NULL AND readable THEN ipp[3] END AS ipp_3,
  CASE WHEN pixel_spacing IS NULL THEN 0 ELSE 2 END AS n_spacing,
  len(image_type) AS n_types, image_type[1] AS first_type
FROM cohort"""))
def instance_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = stored_instances(spark, sf_dir)
    vector = tx.join_values(F.col("ipp").cast("array<string>"))
    raw = headers.withColumns(
        {
            "series_number": F.when(F.length("sequence_name") == 3, "x1").otherwise(
                F.concat(F.lit(" "), F.col("series_number").cast("string"), F.lit(" "))
            ),
            "repetition_time_ms": F.when(
                F.col("acquisition_type") == "2D", F.col("repetition_time_ms").cast("string")
            ).otherwise("12,5"),
            "ipp": F.when(F.col("readable"), vector).otherwise(F.concat(vector, F.lit("\\1.0"))),
            "pixel_spacing": tx.join_values(F.col("pixel_spacing").cast("array<string>")),
            "image_type": F.concat(F.lit("\\"), tx.join_values(F.col("image_type"))),
        }
    )
    return inventory.decode_headers(raw).select(
        "relpath", "series_number", "repetition_time_ms",
        F.size("ipp").cast("bigint").alias("n_ipp"), F.get("ipp", F.lit(2)).alias("ipp_3"),
        F.size("pixel_spacing").cast("int").alias("n_spacing"),
        F.size("image_type").cast("bigint").alias("n_types"),
        F.get("image_type", F.lit(0)).alias("first_type"),
    )


@registered(query(KEYED, """
SELECT DISTINCT center, folder AS subject_folder, subject_id FROM labelled WHERE depth >= 3"""))
def subject_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.subject_dirs(stored_instances(spark, sf_dir))


@registered(query(KEYED, """
SELECT relpath AS source_relpath FROM labelled WHERE NOT (depth >= 3 AND readable AND modality <> '')"""))
def unreadable_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.unreadable(stored_instances(spark, sf_dir))


@registered(query(KEYED, """
SELECT count(*) AS files_seen,
  count(*) FILTER (NOT (depth >= 3 AND readable AND modality <> '')) AS unreadable FROM labelled"""))
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_counts(stored_instances(spark, sf_dir))


@registered("""
SELECT subject_id, string_agg(center, ';' ORDER BY center) AS centers, count(*) AS n_centers FROM (
  SELECT DISTINCT lower(c_mktsegment || c_nationkey) AS subject_id, n_name AS center
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_regionkey = c_nationkey % 5)
GROUP BY subject_id HAVING count(*) > 1""")
def center_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumn("r", F.col("c_nationkey") % 5)
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r")
    visits = table(spark, sf_dir, "orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    ).join(nations, "r")
    paths = visits.select(
        F.concat_ws("/", "n_name", F.concat("c_mktsegment", "c_nationkey"), "o_orderkey").alias("relpath")
    )
    return inventory.center_collisions(inventory.subject_dirs(paths))


_SERIES_OUT = """
SELECT center, subject_id, study_uid_hash, series_uid_hash, series_number, modality, series_description,
  protocol_name, sequence_name, array_to_string(image_type, '\\') AS image_type, manufacturer,
  acquisition_type, repetition_time_ms, slice_thickness_mm, iop[5] AS iop_5, nearest_plane, plane,
  round(plane_angle_deg, 6) AS plane_angle_deg, orientation_consistent,
  round(coverage_mm, 6) AS coverage_mm, instance_count, duplicate_instance_count, inventory_note
FROM series"""


@registered(query(SERIES, _SERIES_OUT))
def series_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_columns(inventory.series_rollup(stored_instances(spark, sf_dir)))


def rollup_columns(series: DataFrame) -> DataFrame:
    return series.select(
        *SERIES_KEYS, "series_number", "modality", "series_description", "protocol_name",
        "sequence_name", tx.join_values(F.col("image_type")).alias("image_type"), "manufacturer",
        "acquisition_type", "repetition_time_ms", "slice_thickness_mm",
        F.get("image_orientation_patient", F.lit(4)).alias("iop_5"), "nearest_plane", "plane",
        r6("plane_angle_deg"), "orientation_consistent", r6("coverage_mm"), "instance_count",
        "duplicate_instance_count", "inventory_note",
    )


def _arrivals(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], int]:
    """The headers as three deliveries, and the buckets they lie in; every series has files in several of them."""
    headers, buckets = dealt_instances(spark, sf_dir)
    part = F.crc32(F.col("relpath").cast("binary")) % 3
    return [headers.filter(part == i) for i in range(3)], buckets


_stores: dict[tuple[str, str], str] = {}


def _kept_up(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The store after three deliveries, made once per application."""
    key, (parts, buckets) = (spark.sparkContext.applicationId, sf_dir), _arrivals(spark, sf_dir)
    if key not in _stores:
        path = scratch_path(spark, "series-store")
        for generation, part in enumerate(parts):
            incremental.update(spark, path, part, generation, buckets)
        _stores[key] = path
    return _stores[key], len(parts) - 1


@registered(query(SERIES, _SERIES_OUT))
def series_in_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries, each merged into the stored states, give the roll-up of all headers."""
    return rollup_columns(incremental.series(spark, *_kept_up(spark, sf_dir)))


@registered(query(KEYED, """
SELECT count(*) AS files_seen,
  count(*) FILTER (NOT (depth >= 3 AND readable AND modality <> '')) AS unreadable FROM labelled"""))
def counts_in_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.counts(spark, *_kept_up(spark, sf_dir))


@registered(query(SERIES, """
SELECT center, subject_id, substr(sha256(study_key), 1, 16) AS study_uid_hash,
  substr(sha256(series_key), 1, 16) AS series_uid_hash, relpath AS source_relpath
FROM numbered WHERE copy_no = 1"""))
def series_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.series_sources(stored_instances(spark, sf_dir))


@registered(query(SERIES, """
SELECT series_uid_hash, study_uid_hash, center, subject_id, source_kind, candidate_type,
  classification_confidence FROM series"""))
def series_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory(stored_instances(spark, sf_dir)).select(
        *SERIES_KEYS, "source_kind", "candidate_type", "classification_confidence"
    )


@registered(query(SERIES, """
SELECT protocol_id, count(*) AS n, min(series_uid_hash) AS first_series FROM series GROUP BY protocol_id"""))
def protocol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    return series.groupBy("protocol_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("series_uid_hash").alias("first_series")
    )


@registered(query(SERIES, """
SELECT protocol_id, c.candidate_type, c.manufacturer, c.model_name, c.software_versions, c.acquisition_type,
  c.repetition_time_ms, c.echo_time_ms, c.inversion_time_ms, c.slice_thickness_mm,
  array_to_string(c.pixel_spacing_mm, '\\') AS pixel_spacing_mm, series_count, subject_count, centers
FROM (SELECT protocol_id, first(series ORDER BY center, subject_id, study_uid_hash, coalesce(series_number, 1000000000), series_uid_hash) AS c,
        count(*) AS series_count, count(DISTINCT subject_id) AS subject_count,
        string_agg(DISTINCT center, ';' ORDER BY center) AS centers
      FROM series GROUP BY protocol_id)"""))
def protocol_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    return catalog.protocol_catalog(series)


@registered(query(SCORES, """
SELECT center, subject_id, study_uid_hash, series_uid_hash, round(volume, 6) AS volume, round(gap, 6) AS gap,
  round(score, 6) AS score FROM scores"""))
def series_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    volume = voxel_volume(F.col("pixel_spacing_mm"), F.col("slice_thickness_mm"))
    return selection.scored(series).select(
        *SERIES_KEYS, F.round(volume, 6).alias("volume"), F.round(slice_gap(), 6).alias("gap"),
        r6("score"),
    )


# ---------------------------------------------------------------------------------------------
# Selection and review
# ---------------------------------------------------------------------------------------------

_SELECTION_COLUMNS = """center, subject_id, study_uid_hash, series_uid_hash, candidate_type,
  decision_status, round(score, 6) AS score, reason, plane AS source_plane, source_kind, protocol_id,
  output_basename"""


def _selection_out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", r6("score"))


@registered(query(SELECTION, f"""
SELECT {_SELECTION_COLUMNS}, '' AS reviewer, '' AS manual_decision FROM selection"""))
def selection_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers to decisions, end to end."""
    headers, buckets = dealt_instances(spark, sf_dir)
    _, chosen = curate(headers, dealt=buckets)
    return _selection_out(chosen)


@registered(query(SELECTION, """
SELECT subject_id FROM selection WHERE decision_status = 'selected' AND candidate_type IN ('t1', 'flair')
GROUP BY subject_id HAVING count(DISTINCT candidate_type) = 2"""))
def both_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.both_modalities(curated(spark, sf_dir)[1])


@registered(query(SELECTION, """
SELECT (SELECT count(*) FROM series) AS series, (SELECT count(DISTINCT subject_id) FROM series) AS subjects,
  (SELECT count(*) FROM labelled) AS files_seen,
  (SELECT count(*) FROM labelled WHERE NOT (depth >= 3 AND readable AND modality <> '')) AS unreadable,
  count(*) FILTER (decision_status = 'selected') AS selected,
  count(*) FILTER (decision_status = 'review') AS review FROM selection"""))
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    return catalog.inventory_summary(stored_instances(spark, sf_dir), series, chosen)


@registered(query(SELECTION, """
SELECT decision_status, count(*) AS n FROM selection GROUP BY 1"""))
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts_by(curated(spark, sf_dir)[1], "decision_status")


def _decision_sheet(chosen: DataFrame) -> DataFrame:
    """Decisions about the series with the greatest hash of every subject and type."""
    rows = chosen.filter(F.col("candidate_type") != "other")
    top = rows.groupBy("subject_id", "candidate_type").agg(
        F.max("series_uid_hash").alias("series_uid_hash")
    )
    digit, kind = F.right("series_uid_hash", F.lit(1)), F.col("source_kind")
    accept = (
        F.when(F.col("candidate_type") == "flair", "accept_flair")
        .when(kind == "original", "accept_original")
        .when(kind == "derived_mpr", "accept_mpr")
        .otherwise("accept_sag_fallback")
    )
    decision = (
        F.when(digit.isin("0", "1", "2"), F.concat(F.lit(" "), accept, F.lit("\t")))
        .when(digit == "3", "exclude")
        .when(digit == "4", "  ")
    )
    base = (
        rows.join(top, ["subject_id", "candidate_type", "series_uid_hash"])
        .withColumn("decision", decision)
        .filter(F.col("decision").isNotNull())
        .withColumn("reviewer", F.concat(F.lit("rev_"), F.left("series_uid_hash", F.lit(1))))
        .select(*review.KEYS, "candidate_type", "source_kind", "decision", "reviewer")
    )
    overruled = base.filter(F.trim("decision") != "").withColumns(
        {"decision": F.lit("exclude"), "position": F.lit(1)}
    )
    return overruled.unionByName(base.withColumn("position", F.lit(2)))


@registered(query(SHEET, f"""
SELECT {_SELECTION_COLUMNS}, reviewer, manual_decision FROM final_selection"""))
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = curated(spark, sf_dir)[1]
    return _selection_out(review.apply_manual_decisions(chosen, _decision_sheet(chosen)))


@registered(query(SELECTION + """,
marks AS (
  SELECT *, CASE d WHEN '0' THEN 'bogus' WHEN '1' THEN 'accept_flair' WHEN '2' THEN 'accept_original'
    WHEN '3' THEN 'accept_mpr' WHEN '4' THEN 'exclude' ELSE 'accept_sag_fallback' END AS decision
  FROM (SELECT *, right(series_uid_hash, 1) AS d FROM selection)
  WHERE d IN ('0', '1', '2', '3', '4', '5')
)""", """
SELECT subject_id, study_uid_hash, series_uid_hash, 'invalid manual decision: ''bogus''' AS problem
FROM marks WHERE decision = 'bogus'
UNION ALL
SELECT * FROM (SELECT subject_id, study_uid_hash, series_uid_hash,
  CASE WHEN decision = 'accept_flair' AND candidate_type <> 'flair' THEN 'accept_flair may only be used for FLAIR candidates'
    WHEN decision IN ('accept_original', 'accept_mpr', 'accept_sag_fallback') AND candidate_type <> 't1' THEN decision || ' may only be used for T1 candidates'
    WHEN decision = 'accept_original' AND source_kind <> 'original' THEN 'accept_original requires an original/primary source'
    WHEN decision = 'accept_mpr' AND source_kind <> 'derived_mpr' THEN 'accept_mpr requires a derived MPR source' END AS problem
  FROM marks WHERE decision <> 'bogus') WHERE problem IS NOT NULL
UNION ALL
SELECT subject_id, min(study_uid_hash), min(series_uid_hash),
  'multiple manually accepted candidates for ' || candidate_type || ': ' || count(*)
FROM marks WHERE decision NOT IN ('bogus', 'exclude') GROUP BY subject_id, candidate_type HAVING count(*) > 1
"""))
def decision_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = curated(spark, sf_dir)[1]
    digit = F.right("series_uid_hash", F.lit(1))
    words = ["bogus", "accept_flair", "accept_original", "accept_mpr", "exclude", "accept_sag_fallback"]
    decision = F.coalesce(*[F.when(digit == str(i), w) for i, w in enumerate(words)])
    sheet = chosen.select(
        *review.KEYS, decision.alias("decision"), F.lit("r").alias("reviewer"),
        F.lit(1).alias("position"),
    ).filter(F.col("decision").isNotNull())
    return review.decision_violations(chosen, sheet)


@registered(query(SHEET, """
SELECT f.center, f.subject_id, f.study_uid_hash, f.series_uid_hash, candidate_type, series_description,
  protocol_name, plane AS source_plane, round(plane_angle_deg, 6) AS plane_angle_deg, source_kind, protocol_id,
  printf('%.6f', score) AS score, reason,
  CASE WHEN right(series_uid_hash, 1) = 'f' THEN 'exclude' ELSE manual_decision END AS decision,
  CASE WHEN right(series_uid_hash, 1) = 'f' THEN 'prior' ELSE reviewer END AS reviewer,
  CASE WHEN right(series_uid_hash, 1) = 'f' THEN 'seen before' ELSE '' END AS comments
FROM final_selection f WHERE decision_status = 'review' OR manual_decision <> ''"""))
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    decided = review.apply_manual_decisions(chosen, _decision_sheet(chosen))
    prior = chosen.select(
        *review.KEYS, F.lit("exclude").alias("decision"), F.lit("prior").alias("reviewer"),
        F.lit("seen before").alias("comments"), F.lit(1).alias("position"),
    ).filter(F.right("series_uid_hash", F.lit(1)) == "f")
    return review.review_sheet(decided, series, prior).withColumn(
        "plane_angle_deg", r6("plane_angle_deg")
    )


# ---------------------------------------------------------------------------------------------
# Pilot
# ---------------------------------------------------------------------------------------------

_PILOT = SELECTION + """,
paired AS (
  SELECT subject_id FROM selection WHERE decision_status = 'selected' GROUP BY 1 HAVING count(DISTINCT candidate_type) = 2
),
strata AS (
  SELECT subject_id, center, CASE WHEN manufacturer = '' THEN 'unknown' ELSE manufacturer END AS manufacturer,
    model_name, protocol_id
  FROM selection JOIN paired USING (subject_id) WHERE decision_status = 'selected' AND candidate_type = 'flair'
),
exceptional AS (
  SELECT DISTINCT 'axial_mpr' AS reason, subject_id FROM selection
  WHERE candidate_type = 't1' AND source_kind = 'derived_mpr' AND plane = 'axial'
  UNION ALL
  SELECT DISTINCT 'review_or_low_confidence', subject_id FROM selection
  WHERE decision_status = 'review' AND (plane IN ('unknown', 'inconsistent') OR classification_confidence <> 'high')
),
pilot AS (
  SELECT subject_id, center, 'flair_protocol_stratum' AS reason,
    concat_ws('|', center, manufacturer, model_name, protocol_id) AS stratum, protocol_id,
    count(*) OVER w AS stratum_available
  FROM strata WINDOW w AS (PARTITION BY center, manufacturer, model_name, protocol_id)
  QUALIFY row_number() OVER (PARTITION BY center, manufacturer, model_name, protocol_id ORDER BY subject_id) <= 2
  UNION ALL
  SELECT e.subject_id, (SELECT min(center) FROM series s WHERE s.subject_id = e.subject_id), reason, reason, '', n
  FROM (SELECT *, count(*) OVER (PARTITION BY reason) AS n FROM exceptional
        QUALIFY row_number() OVER (PARTITION BY reason ORDER BY subject_id) <= 2) e
),
pilot_rows AS (
  SELECT *, 2 AS stratum_target, greatest(0, 2 - stratum_available) AS shortfall FROM pilot
)"""


@registered(query(_PILOT, "SELECT * FROM pilot_rows"))
def pilot_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    return pilot.select_pilot(chosen, series, PilotParams(per_stratum=2))


@registered(query(_PILOT, """
SELECT count(DISTINCT subject_id) AS subjects,
  count(DISTINCT stratum) FILTER (reason = 'flair_protocol_stratum') AS strata,
  count(DISTINCT stratum) FILTER (reason = 'flair_protocol_stratum' AND shortfall > 0) AS strata_with_shortfall
FROM pilot_rows"""))
def pilot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    return pilot.pilot_totals(pilot.select_pilot(chosen, series))


@registered(query(_PILOT, """
SELECT center, manufacturer, model_name, protocol_id, count(*) AS available, greatest(0, 2 - count(*)) AS shortfall
FROM strata GROUP BY ALL"""))
def pilot_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    return (
        pilot.pilot_strata(chosen, series)
        .groupBy(*pilot.STRATUM)
        .agg(F.count(F.lit(1)).alias("available"))
        .withColumn("shortfall", F.greatest(F.lit(0).cast("bigint"), 2 - F.col("available")))
    )
