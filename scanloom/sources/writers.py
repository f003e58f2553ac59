"""Writers. Spark's commit protocol takes the place of write-then-rename."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.text import blank, fixed_decimals, general_8, join_values, walk_order_key
from scanloom.operators.inventory import series_order
from scanloom.operators.pilot import pilot_order
from scanloom.operators.review import review_sheet
from scanloom.operators.selection import selection_order
from scanloom.operators.workplan import diff_log_merge
from scanloom.schemas import (
    ASSET_DIFF,
    CATALOG,
    MANUAL_REVIEW,
    PILOT,
    QC,
    RESULTS,
    SELECTION,
    SERIES,
    columns,
)

UNREADABLE_STATUS = "unreadable_or_non_dicom"


def write_tsv(
    df: DataFrame, path: str, fields: Sequence[str], missing: str = "", mode: str = "overwrite",
    order: Sequence[Column] | None = None, compression: str = "none",
) -> None:
    """The given fields as text; absent or null cells become ``missing``. Cells with tabs, quotes or
    line breaks are quoted, and their white space is kept. With ``order``, files and the lines in
    them follow it. Files may be compressed (``gzip``): names and hashes repeat in every line."""
    if order:
        df = df.orderBy(*order)

    def cell(name: str) -> Column:
        if name not in df.columns:
            return F.lit(missing).alias(name)
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(missing)).alias(name)

    (
        df.select(*[cell(f) for f in fields])
        .write.mode(mode)
        .option("compression", compression)
        .option("sep", "\t")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def public_series(series: DataFrame) -> DataFrame:
    """Series facts that may be shown: no file paths, arrays joined to text."""
    iop = F.transform("image_orientation_patient", general_8)
    return series.withColumns(
        {
            "image_type": join_values(F.col("image_type")),
            "pixel_spacing_mm": join_values(F.col("pixel_spacing_mm").cast("array<string>")),
            "image_orientation_patient": join_values(iop),
        }
    ).select(*[F.col(f"`{c}`") for c in columns(SERIES)])


def write_public_inventory(series: DataFrame, path: str, ordered: bool = False, compression: str = "none") -> None:
    # Sorted before arrays and numbers become text.
    rows = series.orderBy(*series_order()) if ordered else series
    write_tsv(public_series(rows), path, columns(SERIES), compression=compression)


def write_private_inventory(series: DataFrame, sources: DataFrame, path: str) -> None:
    series.write.mode("overwrite").parquet(f"{path}/series")
    sources.write.mode("overwrite").parquet(f"{path}/sources")


def write_unreadable(unreadable: DataFrame, path: str, ordered: bool = False) -> None:
    rows = unreadable.withColumn("status", F.lit(UNREADABLE_STATUS))
    order = [walk_order_key(F.col("source_relpath"))] if ordered else None
    write_tsv(rows, path, ["source_relpath", "status"], order=order)


def write_problems(problems: DataFrame, path: str, ordered: bool = False) -> None:
    write_tsv(problems, path, ["problem"], order=[F.col("problem")] if ordered else None)


def write_catalog(catalog: DataFrame, path: str, ordered: bool = False) -> None:
    write_tsv(catalog, path, columns(CATALOG), order=[F.col("protocol_id")] if ordered else None)


def write_selection(selection: DataFrame, path: str, ordered: bool = False, compression: str = "none") -> None:
    sorted_rows = selection.orderBy(*selection_order()) if ordered else selection
    rows = sorted_rows.withColumn("score", fixed_decimals(F.col("score"), 6))
    write_tsv(rows, path, columns(SELECTION), compression=compression)


def write_review_sheet(
    selection: DataFrame, series: DataFrame, path: str, prior: DataFrame | None = None
) -> None:
    write_review_rows(review_sheet(selection, series, prior), path)


def write_review_rows(sheet: DataFrame, path: str) -> None:
    write_tsv(sheet, path, columns(MANUAL_REVIEW))


def write_results(
    results: DataFrame, path: str, null_text: str = "", ordered: bool = False, compression: str = "none"
) -> None:
    """``null_text='None'`` writes missing values the way older result tables did."""
    order = [F.col(c) for c in ("subject_id", "candidate_type", "series_uid_hash")] if ordered else None
    write_tsv(results, path, columns(RESULTS), missing=null_text, order=order, compression=compression)


def write_pilot(pilot: DataFrame, path: str, ordered: bool = False) -> None:
    write_tsv(pilot, path, columns(PILOT), order=pilot_order() if ordered else None)


def write_qc(rows: DataFrame, path: str) -> None:
    write_tsv(rows, path, columns(QC))


def write_diff_log(prior: DataFrame, new: DataFrame, path: str) -> None:
    """Write the merged log to a new place: a table cannot replace what it is read from."""
    write_tsv(diff_log_merge(prior, new), path, columns(ASSET_DIFF))


def write_dataset_table(df: DataFrame, path: str, key: str | None = None) -> None:
    """A participants or scans table: blank and missing cells read ``n/a``; sorted by ``key`` if given."""
    rows = df.select(*[F.nullif(blank(F.col(c).cast("string")), F.lit("")).alias(c) for c in df.columns])
    write_tsv(rows, path, df.columns, missing="n/a", order=[F.col(key)] if key else None)


def append_samples(samples: DataFrame, path: str) -> None:
    dated = samples.withColumn("day", F.to_date("ts"))
    dated.write.mode("append").partitionBy("day").parquet(path)


def write_pilot_summary(totals: DataFrame, pilot: DataFrame, counts: dict[str, DataFrame], path: str) -> None:
    """Totals and counts as one JSON row beside the entries, which stay a table of their own."""
    summary = totals
    for name, frame in counts.items():
        key = frame.columns[0]
        # Status names are a fixed vocabulary, so this map stays small.
        one = frame.agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("n")))).alias(name)
        )
        summary = summary.withColumn("_one", F.lit(1)).join(
            one.withColumn("_one", F.lit(1)), "_one"
        ).drop("_one")
    summary.write.mode("overwrite").json(f"{path}/summary")
    write_pilot(pilot, f"{path}/entries")
