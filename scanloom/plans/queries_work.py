"""Registered queries over work, lifecycle, checks, exchanged tables and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import text as tx
from scanloom.operators import lifecycle, participants, qc, release, review, validation, workplan
from scanloom.operators.inventory import series_sources
from scanloom.operators.staging import buckets_for, scratch_path
from scanloom.params import ReleasePolicy, ResourceMinimums
from scanloom.plans.cohort import stored_instances, table
from scanloom.plans.oracle_base import SELECTION, SERIES, STAGES, query
from scanloom.plans.queries import ORACLES, curated, curated_series, r6, registered
from scanloom.schemas import SERIES as SERIES_SCHEMA
from scanloom.sources import readers, writers
from scanloom.streaming import lifecycle as streams

# ---------------------------------------------------------------------------------------------
# Lifecycle: events stand for the log, users for series
# ---------------------------------------------------------------------------------------------

_ORDER = ["ts", "event_id"]


def lifecycle_columns(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    stage = (
        F.when(kind == "signup", "queued")
        .when(kind == "view", "linking")
        .when(kind == "click", "dcm2niix")
        .when(kind == "purchase", "converted")
        .otherwise("failed")
    )
    return events.select(
        F.concat(F.lit("u"), "user_id").alias("series_uid_hash"),
        stage.alias("stage"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "value",
    )


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle_columns(table(spark, sf_dir, "events"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest_state(_log(spark, sf_dir), order=_ORDER)


@registered(query(STAGES, "SELECT series_uid_hash, stage, event_id, value FROM latest"))
def lifecycle_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).drop("ts")


def state_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as partial updates: some events tell no value, and the first ones no start."""
    return _log(spark, sf_dir).withColumns(
        {
            "value": F.when(F.col("stage").isin("dcm2niix", "converted"), F.col("value")),
            "started_at": F.when(F.col("stage") != "queued", F.col("event_id")),
        }
    )


@registered(query(STAGES, """
SELECT series_uid_hash, arg_max(stage, (ts, event_id)) AS stage,
  arg_max(value, (ts, event_id)) FILTER (stage IN ('dcm2niix', 'converted')) AS value,
  arg_min(event_id, (ts, event_id)) FILTER (stage <> 'queued') AS started_at, max(event_id) AS event_id
FROM lifecycle GROUP BY 1"""))
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.merged_state(state_updates(spark, sf_dir), "series_uid_hash", _ORDER).select(
        "series_uid_hash", "stage", "value", "started_at", "event_id"
    )


@registered(query(STAGES, "SELECT stage, count(*) AS n FROM latest GROUP BY 1"))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.counts_by_stage(_latest(spark, sf_dir))


_PROGRESS = """
SELECT completed, total, round(completed * 100.0::DOUBLE / total, 2) AS percent,
  round(completed / elapsed * 60, 3) AS series_per_minute,
  CASE WHEN total > completed THEN round((total - completed) / (completed / elapsed), 1) END AS eta_seconds
FROM (SELECT count(*) FILTER (stage IN ('converted', 'failed')) AS completed, count(*) AS total,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS elapsed FROM {rows})"""


def _span():
    return (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6


@registered(query(STAGES, _PROGRESS.format(rows="latest")))
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.run_progress(_latest(spark, sf_dir), _span())


@registered(query(STAGES + """,
scope AS (SELECT 'u' || c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY')""",
_PROGRESS.format(rows="latest WHERE series_uid_hash IN (SELECT k FROM scope)")))
def run_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(
        F.concat(F.lit("u"), "c_custkey").alias("series_uid_hash")
    )
    return lifecycle.run_progress(lifecycle.in_scope(_latest(spark, sf_dir), scope), _span())


@registered(query(STAGES, """
SELECT count(*) FILTER (stage = 'failed') AS failed, count(*) FILTER (stage = 'failed') > 0 AS any_failed FROM latest"""))
def failed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workplan.failed_count(_latest(spark, sf_dir).withColumnRenamed("stage", "status"))


@registered("SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").withColumn("value", F.col("value").cast("string"))
    return lifecycle.latest_sample(samples, ["value"], _ORDER)


@registered("""
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id,
  arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return review.last_per_key(rows, ["user_id", "event_type"], _ORDER).drop("ts")


@registered(query(STAGES, """
SELECT series_uid_hash, 'interrupted' AS stage,
  'worker PID is no longer alive; task is eligible for resume' AS message
FROM latest WHERE stage IN ('queued', 'linking', 'dcm2niix')
  AND ts < (SELECT max(ts) FROM lifecycle) - INTERVAL 6 HOUR"""))
def stale_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    # One aggregate row: the clock of the log.
    now = F.broadcast(log.agg(F.max("ts").alias("now")).withColumn("_one", F.lit(1)))
    states = _latest(spark, sf_dir).withColumn("_one", F.lit(1)).join(now, "_one")
    alive = F.col("ts") >= F.col("now") - F.expr("INTERVAL 6 HOURS")
    return lifecycle.stale_series(states, alive).select("series_uid_hash", "stage", "message")


@registered("""
SELECT event_id, user_id, round(coalesce(CASE WHEN us > lag(us) OVER w
  THEN (value - lag(value) OVER w) / ((us - lag(us) OVER w) / 1e6::DOUBLE) END, 0.0), 6) + 0.0 AS value_per_second
FROM (SELECT *, epoch_us(ts) AS us FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    rates = lifecycle.counter_rates(samples, ["value"], ["user_id"], _ORDER)
    return rates.select("event_id", "user_id", r6("value_per_second"))


@registered("""
SELECT event_id, metric, message FROM (
  SELECT event_id, 'work_free_gb' AS metric, 50.0 AS floor, v AS found, 'work filesystem free space' AS label FROM (SELECT event_id, floor(value * 2) / 2 AS v FROM events)
  UNION ALL SELECT event_id, 'staging_free_gb', 500.0, v * 8, 'staging filesystem free space' FROM (SELECT event_id, floor(value * 2) / 2 AS v FROM events)
  UNION ALL SELECT event_id, 'memory_available_gb', 128.0, v * 2, 'available memory' FROM (SELECT event_id, floor(value * 2) / 2 AS v FROM events)),
  LATERAL (SELECT label || ' ' || printf('%.1f', found::DOUBLE) || ' GiB is below ' || printf('%.1f', floor::DOUBLE) || ' GiB' AS message)
WHERE found < floor""")
def resource_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("value") * 2) / 2
    samples = table(spark, sf_dir, "events").select(
        "event_id", half.alias("work_free_gb"), (half * 8).alias("staging_free_gb"),
        (half * 2).alias("memory_available_gb"),
    )
    return lifecycle.resource_blockers(samples, ResourceMinimums(50.0, 500.0, 128.0), ["event_id"])


@registered("""
SELECT count(*) FILTER (event_type = 'error' AND value >= 50) AS errors,
  count(*) FILTER (event_type <> 'error') AS warnings,
  count(*) FILTER (event_type = 'error' AND value >= 50) = 0 AS passed FROM events""")
def check_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select(
        (F.col("value") < 50).alias("passed"),
        F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"),
    )
    return lifecycle.check_rollup(checks)


#: Rows in a file of the streamed log, and the fewest files it is dealt to.
_FILE_ROWS, _FILES = 2_000_000, 4


def _event_files(spark: SparkSession, sf_dir: str, by_time: bool, close_after: str | None = None) -> DataFrame:
    """The log as a stream of files, one per micro-batch: stretches of time in turn, or each with events of all times.

    One write deals all events, those without an id or a time too; file times then give the stream its order. With
    ``close_after``, a last file holds one event of no series, so much later than all others that every
    event before it is over.
    """
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "event-files")
    files = max(_FILES, -(-events.count() // _FILE_ROWS))
    if by_time:
        dealt = events.repartitionByRange(files, "ts", "event_id")
    else:
        dealt = events.withColumn("_part", F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(files)))
        dealt = dealt.repartition(files, "_part").drop("_part")
    dealt.write.parquet(path)
    if close_after:
        last = events.agg((F.max("ts") + F.expr(f"INTERVAL {close_after}") + F.expr("INTERVAL 1 SECOND")).alias("ts"))
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"]
        last.select("ts", *none).select(*events.columns).coalesce(1).write.mode("append").parquet(path)
    streams.order_files(spark, path)
    return lifecycle_columns(streams.read_event_stream(spark, path, events.schema))


@registered(query(STAGES, "SELECT series_uid_hash, stage, event_id, value FROM latest"))
def lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = streams.latest_state_stream(_event_files(spark, sf_dir, False), "series_uid_hash", _ORDER)
    return streams.run_to_table(
        latest, scratch_path(spark, "latest"), scratch_path(spark, "latest-log"), "series_uid_hash"
    ).drop("ts")


@registered(query(STAGES, "SELECT stage, count(*) AS n FROM latest GROUP BY 1"))
def lifecycle_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stage_counts_stream(
        _event_files(spark, sf_dir, False), scratch_path(spark, "counts"), scratch_path(spark, "counts-log"),
        "series_uid_hash", _ORDER,
    )


@registered(query(STAGES, "SELECT stage, count(*) AS n, round(sum(value), 2) AS total FROM lifecycle GROUP BY 1"))
def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "history")
    events = _event_files(spark, sf_dir, False)
    streams.append_stream(events, path, scratch_path(spark, "history-log")).awaitTermination()
    stored = spark.read.schema(events.schema).parquet(path)
    return stored.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@registered(query(STAGES, """
SELECT series_uid_hash, event_id, round(coalesce(CASE WHEN us > lag(us) OVER w
  THEN (value - lag(value) OVER w) / ((us - lag(us) OVER w) / 1e6::DOUBLE) END, 0.0), 6) + 0.0 AS value_per_second
FROM (SELECT *, epoch_us(ts) AS us FROM lifecycle) WINDOW w AS (PARTITION BY series_uid_hash ORDER BY ts, event_id)"""))
def resource_rate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every file has events of all times, so each may come late by as much as the log is long.
    span = table(spark, sf_dir, "events").agg(
        F.timestamp_diff("SECOND", F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp"))
    ).first()[0]
    lateness = f"{(span or 0) + 1} seconds"
    samples = _event_files(spark, sf_dir, False, close_after=lateness)
    # What the stream has given out; only the closing event still waits.
    rates = streams.drain_append(
        streams.rates_stream(samples, ["value"], "series_uid_hash", _ORDER, lateness),
        scratch_path(spark, "rates"), scratch_path(spark, "rates-log"),
    )
    return rates.select("series_uid_hash", "event_id", r6("value_per_second"))


@registered(query(STAGES, """
SELECT series_uid_hash, 'interrupted' AS stage, event_ts AS last_seen_us,
  'worker PID is no longer alive; task is eligible for resume' AS message
FROM (SELECT *, epoch_us(ts) AS event_ts FROM latest) WHERE stage IN ('queued', 'linking', 'dcm2niix')
  AND ts <= (SELECT max(ts) FROM lifecycle) - INTERVAL 6 HOUR - INTERVAL 1 MINUTE"""))
def stale_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_files(spark, sf_dir, True)
    watched = streams.stale_stream(events, "6 hours", "1 minute", _ORDER)
    found = streams.drain_append(
        watched, scratch_path(spark, "stale"), scratch_path(spark, "stale-log")
    )
    # Silences that are over are left out: the series was heard of again.
    last = _latest(spark, sf_dir).select("series_uid_hash", F.col("ts").alias("last_seen"))
    return found.join(last, ["series_uid_hash", "last_seen"], "left_semi").select(
        "series_uid_hash", "stage", F.unix_micros("last_seen").alias("last_seen_us"), "message"
    )


# ---------------------------------------------------------------------------------------------
# Work planning
# ---------------------------------------------------------------------------------------------

_WORK = SELECTION + """,
work AS (
  SELECT *, CASE WHEN decision_status = 'selected' THEN 'selected' ELSE 'review' END AS mode
  FROM selection WHERE decision_status IN ('selected', 'review')
)"""


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workplan.convertible(curated(spark, sf_dir)[1])


@registered(query(_WORK, """
SELECT subject_id, series_uid_hash, candidate_type, 'dry_run' AS status, mode,
  output_basename AS output_path, reason AS message FROM work
WHERE subject_id IN (SELECT 'p' || lpad(o_orderkey::VARCHAR, 10, '0') FROM orders WHERE o_orderstatus = 'F')"""))
def work_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("sub-P"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("subject_id")
    )
    return workplan.dry_run(workplan.convertible(curated(spark, sf_dir)[1], subjects=listed))


@registered(query(_WORK, """
SELECT subject_id, series_uid_hash, candidate_type, 'failed' AS status, 'inventory' AS mode,
  'series missing from private inventory' AS message FROM work WHERE plane = 'oblique'"""))
def missing_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    return workplan.missing_from_inventory(
        _work(spark, sf_dir), series.filter(F.col("plane") != "oblique")
    )


@registered(query(_WORK + """,
states AS (SELECT *, right(series_uid_hash, 1) AS d, left(series_uid_hash, 1) AS e FROM work),
decided AS (
  SELECT *, CASE WHEN d IN ('0', '1', '2', '3') THEN ['converted', 'review_ready', 'failed', 'linking'][d::INT + 1] END AS stage
  FROM states
)""", """
SELECT subject_id, series_uid_hash, candidate_type,
  CASE WHEN stage IN ('converted', 'review_ready') AND e NOT IN ('a', 'b') THEN 'skipped'
    WHEN stage = 'failed' THEN 'failed' WHEN stage = 'linking' AND e < '8' THEN 'skipped' ELSE 'run' END AS status,
  CASE WHEN stage IN ('converted', 'review_ready') AND e NOT IN ('a', 'b') THEN 'resume'
    WHEN stage = 'failed' THEN 'preserved_failure' WHEN stage = 'linking' AND e < '8' THEN 'active_worker' ELSE mode END AS mode,
  CASE WHEN stage IN ('converted', 'review_ready') AND e NOT IN ('a', 'b') THEN 'verified prior ' || stage || ' output'
    WHEN stage = 'failed' THEN CASE WHEN e = '0' THEN 'disk full' ELSE 'prior failure; use --retry-failed' END
    WHEN stage = 'linking' AND e < '8' THEN 'another live worker owns this series' ELSE '' END AS message,
  CASE WHEN verified THEN 'out/' || series_uid_hash ELSE '' END AS output_path,
  CASE WHEN verified THEN sha256(series_uid_hash) ELSE '' END AS output_sha256,
  CASE WHEN verified THEN 'side/' || series_uid_hash ELSE '' END AS sidecar_path,
  CASE WHEN verified THEN sha256(series_uid_hash) ELSE '' END AS sidecar_sha256,
  CASE WHEN verified OR stage = 'failed' THEN 'start ' || e ELSE '' END AS started_at,
  '' AS finished_at, CASE WHEN verified OR stage = 'failed' THEN 'log/' || series_uid_hash ELSE '' END AS log_path,
  CASE WHEN stage = 'linking' AND e < '8' THEN ascii(e)::BIGINT END AS worker_pid, NULL::BIGINT AS child_pid
FROM (SELECT *, coalesce(stage IN ('converted', 'review_ready') AND e NOT IN ('a', 'b'), FALSE) AS verified FROM decided)"""))
def resume_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = _work(spark, sf_dir)
    h = F.col("series_uid_hash")
    d, e = F.right(h, F.lit(1)), F.left(h, F.lit(1))
    stage = (
        F.when(d == "0", "converted").when(d == "1", "review_ready").when(d == "2", "failed")
        .when(d == "3", "linking")
    )
    state = work.select(
        "series_uid_hash", stage.alias("stage"),
        F.concat(F.lit("out/"), h).alias("output_path"), F.sha2(h, 256).alias("output_sha256"),
        F.concat(F.lit("side/"), h).alias("sidecar_path"), F.sha2(h, 256).alias("sidecar_sha256"),
        F.when(e == "0", "disk full").alias("message"), (e < "8").alias("owner_alive"),
        F.concat(F.lit("start "), e).alias("started_at"), F.concat(F.lit("log/"), h).alias("log_path"),
        F.ascii(e).cast("bigint").alias("worker_pid"),
    ).filter(F.col("stage").isNotNull())
    files = work.select(
        h.alias("h"), F.explode(F.array(F.lit("out/"), F.lit("side/"))).alias("kind"), e.alias("e")
    )
    # Digits a and b stand for an output that changed and a sidecar that is gone.
    digests = files.filter(~((F.col("e") == "b") & (F.col("kind") == "side/"))).select(
        F.concat("kind", "h").alias("path"),
        F.when((F.col("e") == "a") & (F.col("kind") == "out/"), "changed")
        .otherwise(F.sha2("h", 256)).alias("sha256"),
    )
    # Files are twice the work; what meets there is sorted, and a task keeps its part in memory.
    return workplan.resume_decisions(work, state, digests, tasks=buckets_for(spark, 2 * work.count()))


@registered(query(SELECTION, """
SELECT subject_id, suffix AS modality, CASE WHEN old IS NULL THEN 'added' ELSE 'replaced' END AS action,
  coalesce(old, '') AS old_path, coalesce(sha256(old), '') AS old_sha256,
  'sub-' || subject_id || '/anat/' || output_basename || '.nii.gz' AS new_path, series_uid_hash, reason
FROM (SELECT *, CASE WHEN candidate_type = 't1' THEN 'T1w' ELSE 'FLAIR' END AS suffix FROM selection WHERE decision_status = 'selected')
LEFT JOIN (
  SELECT 'p' || lpad(o_orderkey::VARCHAR, 10, '0') AS subject_id, suffix,
    'sub-p' || lpad(o_orderkey::VARCHAR, 10, '0') || '/anat/sub-p' || lpad(o_orderkey::VARCHAR, 10, '0') || '_acq-old_' || suffix || ext AS old
  FROM orders, (VALUES ('T1w', '.nii.gz', 'O'), ('T1w', '.json', 'O'), ('FLAIR', '.nii', 'F')) v(suffix, ext, status)
  WHERE o_orderstatus = status) USING (subject_id, suffix)"""))
def asset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("sub-p"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    endings = (
        F.when(F.col("o_orderstatus") == "O", F.array(F.lit("_T1w.nii.gz"), F.lit("_T1w.json")))
        .when(F.col("o_orderstatus") == "F", F.array(F.lit("_FLAIR.nii")))
        .otherwise(F.array(F.lit("_bold.nii")))
    )
    assets = table(spark, sf_dir, "orders").select(
        subject.alias("s"), F.explode(endings).alias("ending")
    ).select(F.concat("s", F.lit("/anat/"), "s", F.lit("_acq-old"), "ending").alias("relpath"))
    chosen = curated(spark, sf_dir)[1].filter(F.col("decision_status") == "selected")
    return workplan.asset_diff(chosen, assets.withColumn("sha256", F.sha2("relpath", 256)))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("relpath"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("length"),
        F.col("o_orderdate").cast("timestamp").alias("mtime"), "o_orderkey", "o_orderstatus",
    )


_LISTING = """
listing AS (
  SELECT o_orderpriority || '/' || o_orderkey AS relpath, CAST(round(o_totalprice * 100) AS BIGINT) AS length,
    o_orderkey, o_orderstatus, o_orderpriority FROM orders
)"""


@registered(query(_LISTING, """
SELECT relpath, length FROM listing WHERE o_orderstatus <> 'F' OR length % 2 = 1"""))
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _listing(spark, sf_dir)
    there = source.filter(F.col("o_orderstatus") != "O").withColumns(
        {
            "length": F.col("length") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0),
            "mtime": F.when(F.col("length") % 2 == 1, F.col("mtime") + F.expr("INTERVAL 1 SECOND"))
            .otherwise(F.col("mtime")),
        }
    )
    return workplan.copy_plan(source, there).select("relpath", "length")


@registered(query(_LISTING, "SELECT count(*) AS files_total, sum(length)::BIGINT AS bytes_total FROM listing"))
def copy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workplan.copy_totals(_listing(spark, sf_dir))


@registered(query(_LISTING + """,
running AS (
  SELECT relpath, row_number() OVER w AS files_completed, (sum(length) OVER w)::BIGINT AS bytes_completed,
    count(*) OVER () AS files_total, (sum(length) OVER ())::BIGINT AS bytes_total
  FROM listing WINDOW w AS (ORDER BY o_orderpriority, o_orderkey::VARCHAR)
)""", """
SELECT *, round(bytes_completed / (bytes_completed * 0.5::DOUBLE), 6) AS speed_bytes_per_second,
  round((bytes_total - bytes_completed) / 2.0::DOUBLE, 6) AS eta_seconds
FROM running WHERE files_completed % 128 = 0 OR files_completed = files_total"""))
def copy_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = _listing(spark, sf_dir).select("relpath", "length")
    return workplan.copy_progress(listing, seconds_per_byte=0.5).withColumns(
        {c: r6(c) for c in ("speed_bytes_per_second", "eta_seconds")}
    )


@registered("""
SELECT o_orderkey::VARCHAR AS subject_id, o_orderpriority AS modality FROM orders WHERE o_orderstatus IN ('O', 'F')
UNION SELECT o_orderkey::VARCHAR, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def diff_log_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    log = [F.col("o_orderkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("modality")]
    prior = rows.filter(F.col("o_orderstatus").isin("O", "F")).select(*log)
    return workplan.diff_log_merge(prior, rows.filter(F.col("o_orderstatus").isin("F", "P")).select(*log))


# ---------------------------------------------------------------------------------------------
# Quality checks
# ---------------------------------------------------------------------------------------------


def _headers(series: DataFrame) -> DataFrame:
    """Volume headers made up from series facts: every check has series that fail it."""
    n = F.col("instance_count").cast("int")
    d = F.left("series_uid_hash", F.lit(1))
    dims = F.when(d == "0", F.array(n, n, n)).when(
        d == "1", F.array(F.lit(64), F.lit(64), n + 8, n)
    ).otherwise(F.array(F.lit(64), F.lit(64), n + 8))
    th = F.coalesce("slice_thickness_mm", F.lit(1.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    upright = F.array(
        F.array(one, zero, zero, zero), F.array(zero, one, zero, zero),
        F.array(zero, zero, F.when(d == "2", zero).otherwise(th), zero),
        F.array(zero, zero, zero, one),
    )
    return series.withColumns(
        {
            "dims": dims,
            "affine": upright,
            "zooms": F.array(one, one, F.when(d == "3", zero).otherwise(th)),
            "qform_code": F.when(d == "4", 0).otherwise(1),
            "sform_code": F.when(d.isin("4", "5"), 0).otherwise(1),
            "exists": d != "6",
            "read_error": F.when(d == "7", "bad magic"),
        }
    )


_HEADERS = SERIES + """,
headed AS (
  SELECT *, left(series_uid_hash, 1) AS d, CASE WHEN left(series_uid_hash, 1) = '0' THEN [instance_count, instance_count, instance_count]
      WHEN left(series_uid_hash, 1) = '1' THEN [64, 64, instance_count + 8, instance_count] ELSE [64, 64, instance_count + 8] END AS dims,
    '(' || array_to_string(dims, ', ') || ')' AS shape
  FROM series
)"""
_HEADER_CASE = """
  CASE WHEN d = '6' THEN 'selected NIfTI is missing' WHEN d = '7' THEN 'NIfTI cannot be read: bad magic'
    WHEN d = '0' AND instance_count < 8 THEN 'unexpected shape ' || shape WHEN d = '2' THEN 'invalid affine'
    WHEN d = '4' THEN 'both qform and sform are unset'
    ELSE 'shape=' || shape || ';zooms=(1.0, 1.0, ' || CASE WHEN d = '3' THEN 0.0::DOUBLE ELSE slice_thickness_mm END || ')' END"""


@registered(query(_HEADERS, f"""
SELECT center, subject_id, study_uid_hash, series_uid_hash, {_HEADER_CASE} AS detail,
  CASE WHEN d IN ('2', '4', '6', '7') OR (d = '0' AND instance_count < 8) THEN 'fail' ELSE 'pass' END AS status
FROM headed"""))
def header_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    return _headers(series).withColumn("_qc", qc.header_qc()).select(
        "center", "subject_id", "study_uid_hash", "series_uid_hash", "_qc.*"
    )


@registered(query(_HEADERS, """
SELECT center, subject_id, study_uid_hash, series_uid_hash,
  CASE WHEN d = '0' AND instance_count < 8 THEN 'unexpected NIfTI shape: ' || shape
    WHEN d = '1' AND instance_count <> 1 THEN 'structural candidate has multiple volumes: ' || shape
    WHEN d = '2' THEN 'invalid or singular NIfTI affine' WHEN d = '3' THEN 'invalid NIfTI voxel sizes: (1.0, 1.0, 0.0)'
    WHEN iop IS NOT NULL AND d = '8' AND nearest_plane <> 'coronal' THEN 'DICOM/JSON plane mismatch: ' || nearest_plane || ' vs coronal'
    WHEN iop IS NOT NULL AND nearest_plane <> 'axial' THEN 'DICOM/NIfTI affine plane mismatch: ' || nearest_plane || ' vs axial' END AS problem
FROM headed"""))
def conversion_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    coronal = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 0.0, -1.0)])
    volumes = _headers(series).withColumns(
        {
            "header_iop": F.col("image_orientation_patient"),
            "sidecar_iop": F.when(F.left("series_uid_hash", F.lit(1)) == "8", coronal),
        }
    )
    return qc.conversion_check(volumes).select(
        "center", "subject_id", "study_uid_hash", "series_uid_hash", "problem"
    )


_DOUBLED = SELECTION + """,
doubled AS (
  SELECT * REPLACE (CASE WHEN reason IN ('t1_near_tie', 'flair_near_tie') THEN 'selected' ELSE decision_status END AS decision_status)
  FROM selection
)"""


def _with_ties(chosen: DataFrame) -> DataFrame:
    """A selection in which near ties were all let through."""
    tie = F.col("reason").isin("t1_near_tie", "flair_near_tie")
    return chosen.withColumn(
        "decision_status", F.when(tie, "selected").otherwise(F.col("decision_status"))
    )


@registered(query(_DOUBLED, """
SELECT subject_id, candidate_type, count(*) AS n FROM doubled
WHERE decision_status = 'selected' AND candidate_type IN ('t1', 'flair') GROUP BY ALL HAVING count(*) > 1"""))
def duplicate_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.duplicate_selected(_with_ties(curated(spark, sf_dir)[1]))


@registered(query(_DOUBLED + """,
headed AS (
  SELECT *, left(series_uid_hash, 1) AS d, CASE WHEN left(series_uid_hash, 1) = '0' THEN [instance_count, instance_count, instance_count]
      WHEN left(series_uid_hash, 1) = '1' THEN [64, 64, instance_count + 8, instance_count] ELSE [64, 64, instance_count + 8] END AS dims,
    '(' || array_to_string(dims, ', ') || ')' AS shape,
    '/out/sub-' || subject_id || '/anat/' || series_uid_hash || '.nii.gz' AS nifti
  FROM doubled
),
chosen AS (SELECT * FROM headed WHERE decision_status = 'selected'),
pairs AS (
  SELECT subject_id, arg_min(series_uid_hash, (center, study_uid_hash, -score, series_uid_hash)) FILTER (candidate_type = 't1') AS t1,
    arg_min(series_uid_hash, (center, study_uid_hash, -score, series_uid_hash)) FILTER (candidate_type = 'flair') AS flair
  FROM chosen GROUP BY 1
)""", f"""
SELECT subject_id, series_uid_hash, candidate_type,
  CASE WHEN (candidate_type = 't1' AND plane <> 'axial') OR d IN ('2', '4', '6', '7') OR (d = '0' AND instance_count < 8) THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN candidate_type = 't1' AND plane <> 'axial' THEN 'non-axial T1 lacks explicit manual fallback decision' ELSE {_HEADER_CASE} END AS detail,
  nifti, '' AS montage, '' AS registration_metric FROM chosen
UNION ALL
SELECT subject_id, '', candidate_type, 'fail', 'multiple selected ' || candidate_type || ' series: ' || count(*), '', '', ''
FROM chosen GROUP BY subject_id, candidate_type HAVING count(*) > 1
UNION ALL
SELECT subject_id, t1 || '+' || flair, 't1_flair_registration', 'fail', 'rigid mutual-information registration check', '', '', 'missing input'
FROM pairs WHERE t1 IS NOT NULL AND flair IS NOT NULL
UNION ALL
SELECT subject_id, series_uid_hash, candidate_type, 'review', reason, '', '', '' FROM doubled WHERE decision_status = 'review'"""))
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    named = _with_ties(chosen).withColumn("output_basename", F.col("series_uid_hash"))
    where = series.withColumn("output_basename", F.col("series_uid_hash")).withColumn(
        "nifti", qc.selected_path("/out")
    )
    facts = ["nifti", "exists", "read_error", "dims", "affine", "zooms", "qform_code", "sform_code"]
    return qc.qc_summary(named, _headers(where).select(*facts), "/out")


@registered(f"""
SELECT * FROM ({ORACLES['qc_summary']}) WHERE subject_id IN (
  SELECT 'p' || lpad(o_orderkey::VARCHAR, 10, '0') FROM orders WHERE o_orderpriority LIKE '1%')""")
def qc_of_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary for a list of subjects; every selected series must be in the inventory."""
    series, chosen = curated(spark, sf_dir)
    named = _with_ties(chosen).withColumn("output_basename", F.col("series_uid_hash"))
    where = series.withColumn("output_basename", F.col("series_uid_hash")).withColumn("nifti", qc.selected_path("/out"))
    facts = ["nifti", "exists", "read_error", "dims", "affine", "zooms", "qform_code", "sform_code"]
    listed = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(
        F.concat(F.lit("sub-P"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("subject_id")
    )
    return qc.qc_summary(named, _headers(where).select(*facts), "/out", subjects=listed, series=series)


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label as one volume, a voxel per number."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("volume_id"), "vec_id",
        F.posexplode("embedding").alias("pos", "value"),
    )


@registered("""
SELECT label::VARCHAR AS volume_id, round(quantile_cont(v::DOUBLE, 0.01), 6) AS vmin, round(quantile_cont(v::DOUBLE, 0.99), 6) AS vmax
FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY 1""")
def intensity_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.intensity_window(_voxels(spark, sf_dir)).select("volume_id", r6("vmin"), r6("vmax"))


@registered("""
SELECT vec_id, pos, plane FROM (
  SELECT vec_id, unnest(range(64)) AS pos FROM embeddings), LATERAL (
  SELECT CASE axis WHEN 0 THEN 'sagittal' WHEN 1 THEN 'coronal' ELSE 'axial' END AS plane,
    CASE axis WHEN 0 THEN pos // 16 WHEN 1 THEN pos // 4 % 4 ELSE pos % 4 END AS part
  FROM (SELECT unnest([0, 1, 2]) AS axis))
WHERE part = 2""")
def central_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.lit(4)
    cubes = _voxels(spark, sf_dir).withColumns(
        {
            "i": F.expr("pos div 16"), "j": F.expr("pos div 4 % 4"), "k": F.expr("pos % 4"),
            "ni": four, "nj": four, "nk": four,
        }
    )
    return qc.central_slices(cubes).select("vec_id", F.col("pos").cast("bigint").alias("pos"), "plane")


# ---------------------------------------------------------------------------------------------
# Validator reports
# ---------------------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str, root: str, kinds: list[str]) -> DataFrame:
    """A report per event of the given kinds, its error located below ``root``."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*kinds))
    k = F.get_json_object("props", "$.k")
    return events.select(
        F.when(F.col("event_id") % 1000 == 999, "{broken").otherwise(
            F.concat(
                F.lit('{"issues":{"errors":[{"location":"'), F.lit(f"{root}/f"), k,
                F.lit('","code":"'), "user_id", F.lit('"}]}}'),
            )
        ).alias("json")
    )


def _report_errors(name: str, kinds: str) -> str:
    return f"""
{name} AS (
  SELECT DISTINCT CASE WHEN event_id % 1000 = 999 THEN 'validator_result_missing_or_unreadable'
    ELSE '{{"code":"' || user_id || '","location":"<dataset>/f' || json_extract_string(props, '$.k') || '"}}' END AS fingerprint
  FROM events WHERE event_type IN ({kinds})
)"""


_REPORTS = _report_errors("baseline", "'view', 'click', 'signup'") + "," + _report_errors(
    "candidate", "'click', 'error', 'purchase'")


def _both_reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = _reports(spark, sf_dir, "/base/set", ["view", "click", "signup"])
    new = _reports(spark, sf_dir, "/cand/set", ["click", "error", "purchase"])
    return (
        validation.error_fingerprints(old, "/base/set"),
        validation.error_fingerprints(new, "/cand/set"),
    )


@registered(query(_REPORTS, "SELECT fingerprint FROM candidate EXCEPT SELECT fingerprint FROM baseline"))
def new_validator_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.new_errors(*_both_reports(spark, sf_dir))


@registered(query(_REPORTS, """
SELECT (SELECT count(*) FROM baseline) AS baseline_error_count, (SELECT count(*) FROM candidate) AS candidate_error_count,
  (SELECT count(*) FROM (SELECT * FROM candidate EXCEPT SELECT * FROM baseline)) AS new_error_count,
  NOT EXISTS (SELECT 1 FROM baseline WHERE fingerprint LIKE 'validator%') AS baseline_result_readable,
  NOT EXISTS (SELECT 1 FROM candidate WHERE fingerprint LIKE 'validator%') AS candidate_result_readable,
  NOT EXISTS (SELECT * FROM candidate EXCEPT SELECT * FROM baseline)
    AND NOT EXISTS (SELECT 1 FROM candidate WHERE fingerprint LIKE 'validator%') AS passed_no_new_errors"""))
def validator_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.compare_errors(*_both_reports(spark, sf_dir))


# ---------------------------------------------------------------------------------------------
# Dataset tables
# ---------------------------------------------------------------------------------------------


@registered(query(SERIES, """
SELECT coalesce(e.participant_id, 'sub-' || s.subject_id) AS participant_id, coalesce(nullif(segment, ''), 'n/a') AS segment,
  coalesce('site-' || substr(sha256(center), 1, 8), 'n/a') AS site_id
FROM (SELECT 'sub-p' || lpad((c_custkey * 7)::VARCHAR, 10, '0') AS participant_id,
        CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS segment FROM customer) e
FULL JOIN (SELECT DISTINCT subject_id, center FROM series) s ON e.participant_id = 'sub-' || s.subject_id"""))
def participants_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("sub-p"), F.lpad((F.col("c_custkey") * 7).cast("string"), 10, "0")).alias("participant_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    return participants.participants_upsert(existing, curated_series(spark, sf_dir))


@registered(query(SELECTION + """,
incoming AS (
  SELECT subject_id, 'anat/' || output_basename || '.nii.gz' AS filename, protocol_id, plane AS source_plane, source_kind,
    reason AS selection_qc, CASE WHEN candidate_type = 't1' THEN 'T1w' ELSE 'FLAIR' END AS suffix
  FROM selection WHERE decision_status = 'selected'
),
existing AS (
  SELECT 'p' || lpad(o_orderkey::VARCHAR, 10, '0') AS subject_id, o_orderpriority AS operator,
    CASE o_orderstatus WHEN 'O' THEN 'anat/sub-p' || lpad(o_orderkey::VARCHAR, 10, '0') || '_T1w.nii.gz'
      WHEN 'F' THEN 'anat/old_FLAIR.nii' ELSE 'func/old_T1w.nii.gz' END AS filename,
    CASE o_orderstatus WHEN 'O' THEN 'T1w' WHEN 'F' THEN 'FLAIR' END AS suffix
  FROM orders
),
kept AS (
  SELECT * FROM existing e WHERE NOT EXISTS (
    SELECT 1 FROM incoming i WHERE i.subject_id = e.subject_id AND i.suffix = e.suffix AND i.filename <> e.filename)
)""", """
SELECT coalesce(k.subject_id, i.subject_id) AS subject_id, coalesce(k.filename, i.filename) AS filename,
  coalesce(operator, 'n/a') AS operator, coalesce(protocol_id, 'n/a') AS protocol_id, coalesce(source_plane, 'n/a') AS source_plane,
  coalesce(source_kind, 'n/a') AS source_kind, coalesce(selection_qc, 'n/a') AS selection_qc
FROM kept k FULL JOIN incoming i ON k.subject_id = i.subject_id AND k.filename = i.filename"""))
def scans_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"))
    name = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("anat/sub-"), subject, F.lit("_T1w.nii.gz")))
        .when(F.col("o_orderstatus") == "F", "anat/old_FLAIR.nii")
        .otherwise("func/old_T1w.nii.gz")
    )
    existing = table(spark, sf_dir, "orders").select(
        subject.alias("subject_id"), name.alias("filename"), F.col("o_orderpriority").alias("operator")
    )
    chosen = curated(spark, sf_dir)[1].filter(F.col("decision_status") == "selected")
    incoming = chosen.select(
        "subject_id", "candidate_type",
        F.concat(F.lit("anat/"), "output_basename", F.lit(".nii.gz")).alias("filename"),
        "protocol_id", "source_plane", "source_kind", F.col("reason").alias("selection_qc"),
    )
    return participants.scans_upsert(existing, incoming)


# ---------------------------------------------------------------------------------------------
# Text
# ---------------------------------------------------------------------------------------------


@registered("""
SELECT c_custkey, regexp_replace(regexp_replace(lower(CASE WHEN c_custkey % 2 = 0 THEN 'Sub-' ELSE '' END || c_name), '[^a-z0-9]', '', 'g'), '^sub(.)', '\\1') AS subject_id
FROM customer""")
def subject_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Sub-").otherwise(""), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.subject_label(raw).alias("subject_id"))


_UID = "CASE l_linenumber WHEN 1 THEN '1.2.' || l_orderkey WHEN 2 THEN '.1.' || l_orderkey WHEN 3 THEN '1..' || l_orderkey WHEN 4 THEN '1.2a.' || l_orderkey WHEN 5 THEN repeat('1.2.', 16) || l_orderkey WHEN 6 THEN ' 2.' || l_orderkey || ' ' ELSE '' END"


@registered(f"""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, length(trim(uid)) <= 64 AND regexp_full_match(trim(uid), '[0-9]+(\\.[0-9]+)*') AS valid
FROM (SELECT *, {_UID} AS uid FROM lineitem)""")
def uid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("uid", F.expr(_UID)).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", tx.valid_uid(F.col("uid")).alias("valid")
    )


@registered("""
SELECT doc_id, nullif(substr(s, 1, 16), '') AS short_text, nullif(substr(s, 1, 64), '') AS long_text
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '^[\\t-\\r\\x1c-\\x20]+|[\\t-\\r\\x1c-\\x20]+$', '', 'g') AS s FROM documents)""")
def ascii_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.clean_ascii(F.col("text"), 16).alias("short_text"),
        tx.clean_ascii(F.col("text"), 64).alias("long_text"),
    )


@registered("""
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE least(100, floor(value)::INT) END AS percent,
  right(event_type || ': ' || repeat('x', 600) || ' done', 500) AS tail FROM events""")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor("value").cast("int").cast("string")
    line = F.when(F.col("event_type") == "view", "1234%").otherwise(
        F.concat(F.lit("converting 1234% ("), n, F.lit("% of 7%)"))
    )
    tail = F.concat(F.lit(" "), "event_type", F.lit(": "), F.lit("x" * 600), F.lit(" done\n"))
    return table(spark, sf_dir, "events").select(
        "event_id", tx.progress_percent(line).alias("percent"), tx.last_output(tail).alias("tail")
    )


@registered("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size = 15 THEN 'dcmdrle' ELSE 'unsupported' END
  WHEN p_size + 45 IN (80, 81) THEN 'dcmdjpls' WHEN p_size + 45 BETWEEN 90 AND 93 THEN 'python-gdcm' ELSE 'dcmdjpeg' END AS route
FROM part""")
def decoder_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    syntax = F.when(size % 3 == 0, F.concat(F.lit("1.2.840.10008.1.2."), (size / 3).cast("int"))).otherwise(
        F.concat(F.lit("1.2.840.10008.1.2.4."), size + 45)
    )
    return table(spark, sf_dir, "part").select("p_partkey", tx.decoder_route(syntax).alias("route"))


_POLICY = ReleasePolicy(
    forbidden_tokens=("token",), prohibited_suffixes=(".html",), private_paths=("license", "licence"),
    secret_markers=("@example", "BEGIN PRIVATE KEY"), max_bytes=20_000,
)


def _problems(path: str, text: str, length: str, rows: str) -> str:
    return f"""
SELECT DISTINCT label || path AS problem FROM (
  SELECT path, unnest([
    CASE WHEN contains(lower(path), 'token') THEN 'forbidden token in filename: ' END,
    CASE WHEN ends_with(lower(path), '.html') THEN 'prohibited data or credential extension: ' END,
    CASE WHEN length > 20000 THEN 'file exceeds 20000 bytes: ' END,
    CASE WHEN length <= 20000 AND contains(lower(text), 'token') THEN 'forbidden token in content: ' END,
    CASE WHEN length <= 20000 AND (contains(text, 'license') OR contains(text, 'licence')) THEN 'private absolute path in content: ' END,
    CASE WHEN length <= 20000 AND (contains(lower(text), '@example') OR contains(lower(text), 'begin private key')) THEN 'possible credential in content: ' END
  ]) AS label FROM (SELECT {path} AS path, {text} AS text, {length} AS length FROM {rows})
) WHERE label IS NOT NULL"""


@registered(_problems("source || '/' || lang || '/token-' || doc_id || '.txt'", "text", "strlen(text)", "documents"))
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), "lang", F.lit("/token-"), "doc_id", F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("length"), "text",
    )
    return release.release_problems(corpus, _POLICY)


@registered(_problems("url", "html", "strlen(html)", "pages"))
def release_gate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"), F.octet_length("html").cast("bigint").alias("length"),
        F.col("html").alias("text"),
    )
    return release.release_problems(corpus, _POLICY)


@registered("SELECT doc_id, strlen(text) AS length, sha256(text) AS sha256 FROM documents")
def fixity_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("length"), F.sha2("text", 256).alias("sha256")
    )


# ---------------------------------------------------------------------------------------------
# Exchanged formats
# ---------------------------------------------------------------------------------------------


@registered(query(SELECTION, """
SELECT center, subject_id, study_uid_hash, series_uid_hash, candidate_type, decision_status,
  round(score, 6) AS score, reason, output_basename, '' AS reviewer FROM selection"""))
def tsv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "selection-tsv")
    writers.write_selection(curated(spark, sf_dir)[1], path, compression="gzip")
    return readers.read_selection(spark, path).select(
        "center", "subject_id", "study_uid_hash", "series_uid_hash", "candidate_type",
        "decision_status", r6("score"), "reason", "output_basename", "reviewer",
    )


@registered(query(SERIES, """
SELECT center, subject_id, study_uid_hash, series_uid_hash, series_description,
  array_to_string(image_type, '\\') AS image_type, array_to_string(pixel_spacing_mm, '\\') AS pixel_spacing_mm,
  coalesce(array_to_string([CASE WHEN v = 0 THEN '0' WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END for v in iop], '\\'), '') AS image_orientation_patient,
  coalesce(series_number::VARCHAR, '') AS series_number
FROM series"""))
def public_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "inventory-tsv")
    writers.write_public_inventory(curated_series(spark, sf_dir), path, compression="gzip")
    return readers.read_tsv(spark, path).select(
        "center", "subject_id", "study_uid_hash", "series_uid_hash", "series_description",
        "image_type", "pixel_spacing_mm", "image_orientation_patient", "series_number",
    )


@registered(query(SERIES, """
SELECT center, subject_id, study_uid_hash, series_uid_hash, plane, protocol_id, len(image_type) AS n_types,
  round(coverage_mm, 6) AS coverage_mm FROM series"""))
def private_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = curated_series(spark, sf_dir)
    path = scratch_path(spark, "inventory")
    writers.write_private_inventory(series, series_sources(stored_instances(spark, sf_dir)), path)
    return spark.read.parquet(f"{path}/series").select(
        "center", "subject_id", "study_uid_hash", "series_uid_hash", "plane", "protocol_id",
        F.size("image_type").cast("bigint").alias("n_types"), r6("coverage_mm"),
    )


@registered(query(SERIES, """
SELECT subject_id, study_uid_hash, series_uid_hash, series_description, candidate_type, instance_count FROM series"""))
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "series-json")
    # Names and values repeat in every line, so lines take a small part of their room when compressed.
    curated_series(spark, sf_dir).write.json(path, compression="gzip")
    return spark.read.schema(SERIES_SCHEMA).json(path).select(
        "subject_id", "study_uid_hash", "series_uid_hash", "series_description", "candidate_type",
        "instance_count",
    )


@registered("""
SELECT event_id, value, strftime(ts, '%Y-%m-%d') AS day FROM events""")
def append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    samples = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type")
    for late in (False, True):
        part = samples.filter((F.col("event_type") == "error") == F.lit(late))
        writers.append_samples(part.drop("event_type"), path)
    return spark.read.parquet(path).select(
        "event_id", "value", F.col("day").cast("string").alias("day")
    )


@registered("""
SELECT 'sub-' || c_custkey AS participant_id, coalesce(nullif(CASE WHEN c_nationkey = 3 THEN '' ELSE c_name || ' "x"' END, ''), 'n/a') AS name
FROM customer""")
def dataset_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "participants")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("sub-"), "c_custkey").alias("participant_id"),
        F.when(F.col("c_nationkey") == 3, "").otherwise(F.concat("c_name", F.lit(' "x"'))).alias("name"),
    )
    writers.write_dataset_table(rows, path)
    return readers.read_dataset_table(spark, path, "participant_id")
