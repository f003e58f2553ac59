"""Registered queries over readers and sinks: what is written comes back through the package's own reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanloom.functions import text as tx
from scanloom.operators import catalog, inventory, pilot, release, validation, workplan
from scanloom.operators.ordering import range_chunks, running_totals
from scanloom.operators.staging import scratch_path
from scanloom.params import PilotParams, ReleasePolicy
from scanloom.plans import queries, queries_work
from scanloom.plans.cohort import stored_instances, table
from scanloom.plans.oracle_base import SELECTION, query
from scanloom.plans.queries import ORACLES, curated, curated_series, registered
from scanloom.sources import merging, readers, writers


def _returned(spark: SparkSession, label: str, df: DataFrame, write: Callable[[str], None]) -> DataFrame:
    """Write, read as TSV, and give every cell the type that it had."""
    path = scratch_path(spark, label)
    write(path)
    back = readers.read_tsv(spark, path)

    def cell(name: str, kind: str) -> Column:
        if kind == "string":
            return F.col(name)
        return F.nullif(F.col(name), F.lit("")).try_cast(kind).alias(name)

    return back.select(*[cell(c, t) for c, t in df.dtypes])


def _blank_text(sql: str, *columns: str) -> str:
    """A query whose text cells are never null, as in a TSV."""
    blanks = ", ".join(f"coalesce({c}, '') AS {c}" for c in columns)
    return f"SELECT * REPLACE ({blanks}) FROM ({sql})"


@registered(f"SELECT source_relpath, '{writers.UNREADABLE_STATUS}' AS status FROM ({ORACLES['unreadable_instances']})")
def unreadable_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = inventory.unreadable(stored_instances(spark, sf_dir))
    path = scratch_path(spark, "unreadable")
    writers.write_unreadable(lost, path)
    return readers.read_tsv(spark, path)


@registered(_blank_text(ORACLES["protocol_catalog"], "manufacturer", "model_name", "software_versions", "acquisition_type", "pixel_spacing_mm"))
def catalog_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.protocol_catalog(curated_series(spark, sf_dir))
    return _returned(spark, "catalog", rows, lambda path: writers.write_catalog(rows, path))


@registered("SELECT * REPLACE (coalesce(comments, '') AS comments) FROM (" + ORACLES["review_sheet"] + ")")
def review_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries.review_sheet(spark, sf_dir)
    return _returned(spark, "review-sheet", rows, lambda path: writers.write_review_rows(rows, path))


@registered(_blank_text(ORACLES["pilot_subjects"], "stratum", "protocol_id"))
def pilot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    rows = pilot.select_pilot(chosen, series, PilotParams(per_stratum=2))
    return _returned(spark, "pilot", rows, lambda path: writers.write_pilot(rows, path))


@registered("SELECT subjects, strata, strata_with_shortfall, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failed FROM ("
            + ORACLES["pilot_totals"] + ")")
def pilot_summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    rows = pilot.select_pilot(chosen, series, PilotParams(per_stratum=2))
    status = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    counts = catalog.counts_by(table(spark, sf_dir, "orders").withColumn("status", status), "status")
    path = scratch_path(spark, "pilot-summary")
    writers.write_pilot_summary(pilot.pilot_totals(rows), rows, {"status": counts}, path)
    return spark.read.json(f"{path}/summary").select(
        "subjects", "strata", "strata_with_shortfall", F.col("status.failed").alias("failed")
    )


@registered(_blank_text(ORACLES["resume_decisions"], "message", "output_path"))
def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries_work.resume_decisions(spark, sf_dir)
    return _returned(spark, "results", rows, lambda path: writers.write_results(rows, path, compression="gzip"))


@registered(f"SELECT subject_id, series_uid_hash, status, detail FROM ({ORACLES['header_qc']})")
def qc_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries_work.header_qc(spark, sf_dir)
    path = scratch_path(spark, "qc")
    writers.write_qc(rows, path)
    return readers.read_tsv(spark, path).select("subject_id", "series_uid_hash", "status", "detail")


@registered(f"SELECT DISTINCT * FROM ({ORACLES['asset_diff']})")
def diff_log_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of half of the differences, merged with all of them: every row stays once."""
    rows = queries_work.asset_diff(spark, sf_dir)
    first, merged = scratch_path(spark, "diff-log"), scratch_path(spark, "diff-log")
    writers.write_tsv(rows.filter(F.col("action") == "added"), first, rows.columns)
    writers.write_diff_log(readers.read_tsv(spark, first), rows, merged)
    return readers.read_tsv(spark, merged)


@registered(f"SELECT DISTINCT * FROM ({ORACLES['asset_diff']})")
def diff_log_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored log to which all differences are added where it lies, half of which it has."""
    rows = queries_work.asset_diff(spark, sf_dir)
    path = scratch_path(spark, "diff-log")
    merging.add_to_diff_log(spark, path, rows.filter(F.col("action") == "added"))
    merging.add_to_diff_log(spark, path, rows)
    return merging.current(spark, path)


@registered(ORACLES["state_upsert"])
def states_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored states that take the earlier and then the later half of the log's time."""
    updates = queries_work.state_updates(spark, sf_dir)
    middle = updates.agg(F.timestamp_micros(F.avg(F.unix_micros("ts")).cast("bigint"))).first()[0]
    path = scratch_path(spark, "states")
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        merging.update_states(spark, path, updates.filter(part), "series_uid_hash", ["ts", "event_id"])
    return merging.current(spark, path).select("series_uid_hash", "stage", "value", "started_at", "event_id")


# One file per supplier, so that the number of files follows the data.


def _files(spark: SparkSession, sf_dir: str, label: str, text: Column) -> str:
    path = scratch_path(spark, label)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value"))
    # Few bytes but many files: a number of tasks that is asked for stays, and each moves its own files into place.
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(path)
    return path


def _key() -> Column:
    return F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("bigint").alias("s_suppkey")


@registered("""
SELECT s_suppkey, 's_suppkey=' || s_suppkey AS folder, strlen(s_name) + 1 AS length FROM supplier""")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _files(spark, sf_dir, "listing", F.col("s_name"))
    found = readers.file_listing(spark, path)
    folder = tx.parent_dir(F.col("relpath"))
    key = F.regexp_extract(folder, r"(\d+)$", 1).cast("bigint")
    return found.select(key.alias("s_suppkey"), folder.alias("folder"), "length")


@registered("SELECT s_suppkey, strlen(s_name) + 1 AS length, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def fixity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.fixity(spark, _files(spark, sf_dir, "fixity", F.col("s_name"))).select(_key(), "length", "sha256")


@registered("SELECT 'u' || s_suppkey AS series_uid_hash, s_name AS stage FROM supplier WHERE s_suppkey % 10 > 1")
def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = F.to_json(F.struct(F.concat(F.lit("u"), "s_suppkey").alias("series_uid_hash"), F.col("s_name").alias("stage")))
    rest = F.col("s_suppkey") % 10
    text = F.when(rest == 0, "{broken").when(rest == 1, "[1, 2]").otherwise(document)
    path = _files(spark, sf_dir, "states", text)
    return readers.read_state_documents(spark, path, "series_uid_hash STRING, stage STRING").select("series_uid_hash", "stage")


@registered("""
SELECT DISTINCT CASE s_suppkey % 10 WHEN 0 THEN 'validator_result_missing_or_unreadable'
  WHEN 1 THEN 'plain "/set/' || s_nationkey || '"' WHEN 2 THEN 'None' WHEN 3 THEN s_nationkey::VARCHAR WHEN 4 THEN 'True'
  ELSE '{"code":"' || s_nationkey || '","location":"<dataset>/f"}' END AS fingerprint FROM supplier WHERE s_suppkey % 10 <> 5
UNION SELECT 'validator_result_missing_or_unreadable'""")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose issues are objects, text, null, a number or true; broken ones, empty ones, and one that is not there."""
    kind, code = F.col("s_suppkey") % 10, F.col("s_nationkey").cast("string")
    issue = (
        F.when(kind == 1, F.concat(F.lit('"plain \\"/set/'), code, F.lit('\\""')))
        .when(kind == 2, "null").when(kind == 3, code).when(kind == 4, "true")
        .otherwise(F.concat(F.lit('{"location":"/set/f",\n"code":"'), code, F.lit('"}')))
    )
    report = F.concat(F.lit('{"issues":{"errors":['), F.when(kind == 5, "").otherwise(issue), F.lit("]}}"))
    path = _files(spark, sf_dir, "reports", F.when(kind == 0, "{broken").otherwise(report))
    reports = readers.read_reports(spark, path).unionByName(readers.read_reports(spark, f"{path}-absent/report.json"))
    return validation.error_fingerprints(reports, "/set")


@registered("""
SELECT DISTINCT CASE WHEN strlen(s_name) + s_suppkey % 7 + 1 > 20 THEN 'file exceeds 20 bytes: ' ELSE 'forbidden token in content: ' END
  || 's_suppkey=' || s_suppkey AS problem FROM supplier""")
def release_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = ReleasePolicy(max_bytes=20, forbidden_tokens=("supplier",))
    path = _files(spark, sf_dir, "release", F.concat("s_name", F.repeat(F.lit("."), F.col("s_suppkey") % 7)))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = release.release_corpus(files, policy).withColumn(
        "path", F.regexp_extract("path", r"(s_suppkey=\d+)", 1)
    )
    return release.release_problems(release.to_check(named, policy), policy)


@registered("""
SELECT DISTINCT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS subject_id FROM customer WHERE c_custkey % 5 > 0""")
def subject_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "subjects")
    line = F.concat(
        F.when(F.col("c_custkey") % 5 == 0, "# ").otherwise("sub-"), "c_name", F.lit("\t"), "c_mktsegment"
    )
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return readers.read_subject_list(spark, path)


#: Series in one array.
_ARRAY_SERIES = 2_000
_JSON_OUT = f"SELECT subject_id, study_uid_hash, series_uid_hash, candidate_type, instance_count FROM ({ORACLES['json_roundtrip']})"


def _series_arrays(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """Arrays of a bounded number of series each; how many there are follows the table."""
    series = curated_series(spark, sf_dir)
    path = scratch_path(spark, "series-arrays")
    whole = F.struct(*[F.col(f"`{c}`") for c in series.columns], F.array(F.lit("x")).alias("source_relpaths"))
    arrays = -(-series.count() // _ARRAY_SERIES) or 1
    parts = series.withColumn("part", F.pmod(F.xxhash64("subject_id", "study_uid_hash", "series_uid_hash"), F.lit(arrays)))
    texts = parts.groupBy("part").agg(F.to_json(F.collect_list(whole)).alias("value"))
    # One row per part and each in one task already: the texts do not move again.
    texts.write.option("compression", compression).partitionBy("part").text(path)
    return path


@registered(_JSON_OUT)
def series_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, _ = readers.read_series_json(spark, f"{_series_arrays(spark, sf_dir, 'gzip')}/*", split=False)
    return facts.select("subject_id", "study_uid_hash", "series_uid_hash", "candidate_type", "instance_count")


@registered(_JSON_OUT)
def series_json_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same arrays, read piece by piece and put together to objects, as files larger than a task's share are."""
    facts, _ = readers.read_series_json(spark, f"{_series_arrays(spark, sf_dir, 'gzip')}/*", split=True)
    return facts.select("subject_id", "study_uid_hash", "series_uid_hash", "candidate_type", "instance_count")


@registered("""
SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority || chr(10) || '"' || o_orderstatus || chr(9) || o_custkey || chr(10) AS note, o_orderstatus
FROM orders""")
def tsv_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks, tabs and quotes in files that are cut between their records."""
    note = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit("\t"), "o_custkey", F.lit("\n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note"), "o_orderstatus")
    path = scratch_path(spark, "tsv-pieces")
    writers.write_tsv(rows, path, rows.columns)
    return readers.read_tsv(spark, path, split=True)


@registered("""
SELECT s_suppkey, 's_suppkey=' || s_suppkey AS folder, strlen(s_name) + 1 AS length FROM supplier""")
def walked_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.walked_listing(spark, _files(spark, sf_dir, "walk", F.col("s_name")))
    folder = tx.parent_dir(F.col("relpath"))
    data = found.filter(F.col("relpath").endswith(".txt"))
    return data.select(F.regexp_extract(folder, r"(\d+)$", 1).cast("bigint").alias("s_suppkey"), folder.alias("folder"), "length")


@registered("SELECT s_suppkey, strlen(s_name) + 1 AS length, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def fixity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file digested block by block, as large ones are."""
    return readers.fixity(spark, _files(spark, sf_dir, "fixity", F.col("s_name")), whole_file=0).select(_key(), "length", "sha256")


@registered("""
SELECT value AS disk_write_bytes_per_second, NULL::DOUBLE AS network_sent_bytes_per_second,
  user_id::DOUBLE AS nfs_write_bytes_per_second FROM events ORDER BY ts DESC, event_id DESC LIMIT 1""")
def resource_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a log that was written in the order of time; a cell that is no number is null."""
    names = readers.RATE_NAMES
    log = table(spark, sf_dir, "events").select(
        "ts", "event_id", F.col("value").alias(names[0]), F.lit("n/a").alias(names[1]), F.col("user_id").alias(names[2])
    )
    path = scratch_path(spark, "resource-log")
    writers.write_tsv(log, path, log.columns, order=[F.col("ts"), F.col("event_id")])
    return readers.read_latest_rates(spark, path)


# The lines of sorted files, numbered as they lie there.


def _lines(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = readers.read_tsv(spark, path, "_position").select(*keys, "_position.*")
    order = ["file", "line"]
    chunked = range_chunks(rows, order, "lines")
    return running_totals(chunked, order, {"n": F.lit(1)}).select(*keys, "n")


def _numbered(sql: str, keys: str, order: str) -> str:
    return f"SELECT {keys}, row_number() OVER (ORDER BY {order}) AS n FROM ({sql})"


_SERIES_KEYS = ["center", "subject_id", "study_uid_hash", "series_uid_hash"]


@registered(_numbered(
    ORACLES["series_rollup"], ", ".join(_SERIES_KEYS),
    "center, subject_id, study_uid_hash, coalesce(series_number, 1000000000), series_uid_hash"))
def series_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "series-lines")
    writers.write_public_inventory(curated_series(spark, sf_dir), path, ordered=True, compression="gzip")
    return _lines(spark, path, _SERIES_KEYS)


@registered(query(SELECTION, """
SELECT subject_id, study_uid_hash, series_uid_hash, row_number() OVER (
  ORDER BY center, subject_id, study_uid_hash, candidate_type, score DESC, series_uid_hash) AS n FROM selection"""))
def selection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "selection-lines")
    writers.write_selection(curated(spark, sf_dir)[1], path, ordered=True, compression="gzip")
    return _lines(spark, path, ["subject_id", "study_uid_hash", "series_uid_hash"])


@registered(_numbered(ORACLES["pilot_subjects"], "center, subject_id, reason, stratum", "center, subject_id, reason, stratum"))
def pilot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    series, chosen = curated(spark, sf_dir)
    path = scratch_path(spark, "pilot-lines")
    writers.write_pilot(pilot.select_pilot(chosen, series, PilotParams(per_stratum=2)), path, ordered=True)
    return _lines(spark, path, ["center", "subject_id", "reason", "stratum"])


@registered(_numbered(
    ORACLES["resume_decisions"], "subject_id, candidate_type, series_uid_hash", "subject_id, candidate_type, series_uid_hash"))
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "result-lines")
    writers.write_results(queries_work.resume_decisions(spark, sf_dir), path, ordered=True, compression="gzip")
    return _lines(spark, path, ["subject_id", "candidate_type", "series_uid_hash"])


@registered(_numbered(ORACLES["protocol_catalog"], "protocol_id", "protocol_id"))
def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "catalog-lines")
    writers.write_catalog(catalog.protocol_catalog(curated_series(spark, sf_dir)), path, ordered=True)
    return _lines(spark, path, ["protocol_id"])


@registered(f"""
SELECT source_relpath, row_number() OVER (ORDER BY
  list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = len(p) THEN '0' ELSE '1' END || p[i])) AS n
FROM (SELECT source_relpath, string_split(source_relpath, '/') AS p FROM ({ORACLES['unreadable_instances']}))""")
def unreadable_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "unreadable-lines")
    writers.write_unreadable(inventory.unreadable(stored_instances(spark, sf_dir)), path, ordered=True)
    return _lines(spark, path, ["source_relpath"])


@registered("""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_of_subject,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey::VARCHAR) AS n FROM orders""")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of work among its subject's as it comes out of the execution order."""
    work = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("candidate_type"),
        F.col("o_orderkey").cast("string").alias("series_uid_hash"),
    )
    # What was written task by task: a subject is in one task, and its rows follow each other.
    path = scratch_path(spark, "jobs")
    placed = workplan.execution_order(work).withColumn("at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    subject = Window.partitionBy("subject_id")
    return spark.read.parquet(path).select(
        "o_orderkey", F.count(F.lit(1)).over(subject).alias("n_of_subject"), F.row_number().over(subject.orderBy("at")).alias("n")
    )


@registered("SELECT * REPLACE (instance_count + 2 * duplicate_instance_count AS duplicate_instance_count) FROM ("
            + ORACLES["series_rollup"] + ")")
def series_rollup_doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every header stored twice: the copies of a row are one file, whichever plan a series takes."""
    once = stored_instances(spark, sf_dir)
    return queries.rollup_columns(inventory.series_rollup(once.unionByName(once)))
