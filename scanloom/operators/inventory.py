"""From one row per image instance to one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanloom.functions import text as tx
from scanloom.functions.geometry import (
    add_plane,
    add_slice_normal,
    all_finite,
    angle_from_cosine,
    at,
    dot,
    xyz,
)
from scanloom.functions.scoring import candidate, protocol_id, series_text, source_kind
from scanloom.operators.skew import HOT_ROWS, hot_keys, join_null_safe, null_safe
from scanloom.operators.staging import stage
from scanloom.params import SelectionParams
from scanloom.schemas import INSTANCES, SERIES, SERIES_SOURCES, columns

GROUP_KEYS = ["center", "subject_id", "study_key", "series_key"]

# Attributes a series takes from its first file, under their series names.
_TEXT_ATTRIBUTES = [
    "modality", "series_description", "protocol_name", "sequence_name", "manufacturer",
    "model_name", "software_versions", "acquisition_type",
]
_NUMBER_ATTRIBUTES = [
    "series_number", "repetition_time_ms", "echo_time_ms", "inversion_time_ms", "flip_angle_deg",
    "rows", "columns", "slice_thickness_mm", "spacing_between_slices_mm",
]


def decode_headers(raw: DataFrame) -> DataFrame:
    """Coerce textual header fields to the instance schema; malformed values become null."""
    doubles = {
        "repetition_time_ms", "echo_time_ms", "inversion_time_ms", "flip_angle_deg",
        "slice_thickness_mm", "spacing_between_slices_mm",
    }
    integers = {"series_number", "rows", "columns"}
    vectors = {"pixel_spacing": 2, "iop": 6, "ipp": 3}
    kinds = dict(raw.dtypes)
    out = []
    for name in columns(INSTANCES):
        c = F.col(f"`{name}`")
        if name not in kinds:
            continue
        if name in doubles and kinds[name] != "double":
            c = tx.safe_double(c)
        elif name in integers and kinds[name] == "string":
            c = tx.safe_int(c)
        elif name in integers:
            c = c.try_cast("int")
        elif name in vectors:
            n = vectors[name]
            c = tx.text_vector(c, n) if kinds[name] == "string" else tx.fixed_vector(c, n)
        elif name == "image_type" and kinds[name] == "string":
            c = tx.split_values(c)
        out.append(c.alias(name))
    return raw.select(*out)


def path_parts(df: DataFrame, path: str = "relpath") -> DataFrame:
    """Add ``depth``, ``center`` and ``subject_folder`` of a ``center/subject/.../file`` path."""
    whole = F.col(path)
    # Only the beginning is taken apart: paths are long, and this is done for every file.
    beginning = F.substring_index(whole, "/", 2)
    return df.withColumns(
        {
            "depth": F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("/"), F.lit(""))) + 1,
            "center": F.substring_index(whole, "/", 1),
            "subject_folder": F.when(F.contains(whole, F.lit("/")), F.substring_index(beginning, "/", -1)),
        }
    )


def subject_dirs(instances: DataFrame) -> DataFrame:
    """Distinct center, subject folder and label of all files that lie in a subject folder."""
    return (
        path_parts(instances.select("relpath"))
        .filter(F.col("depth") >= 3)
        .select("center", "subject_folder", tx.subject_label(F.col("subject_folder")).alias("subject_id"))
        .distinct()
    )


def subject_sizes(instances: DataFrame, dealt: bool = False) -> DataFrame:
    """Image planes of usable files by subject folder: one pass over few columns, one row per folder.

    Columns: center, subject_folder, subject_id, planes. ``dealt`` as in ``series_rollup``.
    """
    needed = ["relpath", "readable", "modality", "frame_iops", "frame_ipps"] + ["subject_id"] * dealt
    inside = path_parts(instances.select(*needed)).filter(F.col("depth") >= 3)
    planes = F.sum(F.when(_is_usable(), _planes()).otherwise(0)).alias("planes")
    if dealt:
        folders = inside.groupBy("subject_id", "center", "subject_folder").agg(planes)
        return folders.select("center", "subject_folder", "subject_id", "planes")
    folders = inside.groupBy("center", "subject_folder").agg(planes)
    # A label is worked out once per folder.
    return folders.select("center", "subject_folder", tx.subject_label(F.col("subject_folder")).alias("subject_id"), "planes")


def crowded_subjects(sizes: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """The subjects with at least ``rows`` image planes (``subject_sizes``): no other one can have a series that large."""
    planes = sizes.groupBy("subject_id").agg(F.sum("planes").alias("planes"))
    return planes.filter(F.col("planes") >= rows).select("subject_id")


def marked_subjects(sizes: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """The subjects (``subject_sizes``) that are ``unusable``, for want of a label or for two centers, or ``crowded``
    (``crowded_subjects``): one exchange tells whether there are any."""
    subjects = sizes.groupBy("subject_id").agg(
        (F.sum("planes") >= rows).alias("crowded"),
        (F.col("subject_id").isNull() | (F.min("center") != F.max("center"))).alias("unusable"),
    )
    return subjects.filter("crowded or unusable")


def invalid_subject_folders(instances: DataFrame) -> DataFrame:
    """Folders whose name leaves no usable label."""
    return _invalid(subject_dirs(instances))


def _invalid(dirs: DataFrame) -> DataFrame:
    dirs = dirs.filter(F.col("subject_id").isNull())
    message = F.concat(
        F.lit("subject folder does not produce a valid BIDS label: '"),
        F.col("subject_folder"),
        F.lit("'"),
    )
    return dirs.select("center", "subject_folder", message.alias("problem"))


def center_collisions(dirs: DataFrame) -> DataFrame:
    """Subject labels that occur in more than one center."""
    pairs = dirs.select("subject_id", "center").distinct()
    return (
        pairs.groupBy("subject_id")
        .agg(F.array_sort(F.collect_set("center")).alias("centers"))
        .filter(F.size("centers") > 1)
        .select(
            "subject_id",
            F.array_join("centers", ";").alias("centers"),
            F.size("centers").cast("bigint").alias("n_centers"),
        )
    )


def subject_problems(instances: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Everything that makes subjects unusable: (subject_id, problem), null where no label is left.

    Such subjects must not be curated: two centers with one label would become one person. With ``sizes``
    (``subject_sizes``) the instances are not read again.
    """
    dirs = subject_dirs(instances) if sizes is None else sizes.select("center", "subject_folder", "subject_id").distinct()
    doubled = center_collisions(dirs).select(
        "subject_id",
        F.concat(F.lit("subject label in several centers: sub-"), "subject_id", F.lit(": "), "centers").alias("problem"),
    )
    unusable = _invalid(dirs).select(
        F.lit(None).cast("string").alias("subject_id"),
        F.concat("problem", F.lit(" in "), "center").alias("problem"),
    )
    return doubled.unionByName(unusable)


def raise_problems(problems: DataFrame, shown: int = 20) -> None:
    """Fail when there is any problem; the message names the first ones and how many more there are."""
    found = problems.orderBy("problem").limit(shown).collect()
    if found:
        more = problems.count() - len(found)
        tail = f"; and {more} more" if more else ""
        raise ValueError("; ".join(r["problem"] for r in found) + tail)


def without_subjects(instances: DataFrame, problems: DataFrame) -> DataFrame:
    """Instances of subjects that have no problem; files outside subject folders stay as they are."""
    labelled = path_parts(instances).withColumn("_label", tx.subject_label(F.col("subject_folder")))
    bad = problems.filter(F.col("subject_id").isNotNull()).select(F.col("subject_id").alias("_label")).distinct()
    usable = (F.col("depth") < 3) | F.col("_label").isNotNull()
    return labelled.filter(usable).join(bad, "_label", "left_anti").select(*instances.columns)


def _is_usable() -> Column:
    return F.coalesce(
        (F.col("depth") >= 3) & F.col("readable") & (tx.blank(F.col("modality")) != ""),
        F.lit(False),
    )


def unreadable(instances: DataFrame) -> DataFrame:
    """Files left out of the inventory: outside a subject folder, undecodable or without modality."""
    parts = path_parts(instances.select("relpath", "readable", "modality"))
    return parts.filter(~_is_usable()).select(F.col("relpath").alias("source_relpath"))


def inventory_counts(instances: DataFrame) -> DataFrame:
    parts = path_parts(instances.select("relpath", "readable", "modality"))
    return parts.agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.count_if(~_is_usable()).alias("unreadable"),
    )


def _labelled(instances: DataFrame) -> DataFrame:
    """Usable instances with their subject."""
    usable = path_parts(instances).filter(_is_usable())
    return usable.withColumn("subject_id", tx.subject_label(F.col("subject_folder")))


def _keyed(instances: DataFrame) -> DataFrame:
    """Usable instances with their group keys."""
    return _with_keys(_labelled(instances))


def _by_subject(instances: DataFrame, buckets: int, dealt: bool) -> DataFrame:
    """As ``_keyed``, whole subjects in one of ``buckets`` tasks. Keys repeat what paths and identifiers say, so they
    are made behind the exchange, if there is one."""
    if dealt:
        rows = path_parts(instances).filter(_is_usable())
    else:
        rows = _labelled(instances).select("subject_id", *[f"`{c}`" for c in columns(INSTANCES)])
        rows = rows.repartition(buckets, "subject_id").withColumn("center", F.substring_index("relpath", "/", 1))
    return _with_keys(rows)


def _with_keys(labelled: DataFrame) -> DataFrame:
    # The center is read off the path again: columns that no step uses twice are made in one step, and rows copied once.
    center = F.substring_index("relpath", "/", 1)
    return labelled.withColumns(
        {
            "study_key": F.coalesce(
                F.nullif("study_uid", F.lit("")),
                F.concat(F.lit("missing-study:"), center, F.lit("/"), "subject_id"),
            ),
            "series_key": F.coalesce(
                F.nullif("series_uid", F.lit("")),
                F.concat(F.lit("missing-series:"), tx.parent_dir(F.col("relpath"))),
            ),
            "sop_key": F.coalesce(F.nullif("sop_uid", F.lit("")), F.col("relpath")),
        }
    )


def _walk() -> Column:
    """Walk order of a file. Rows of one path that differ are told apart by a hash of the row."""
    return F.struct(
        tx.walk_order_key(F.col("relpath")).alias("path"),
        F.xxhash64(*[F.col(f"`{c}`") for c in columns(INSTANCES)]).alias("row"),
    )


def _planes() -> Column:
    """How many image planes a file has, its own included."""
    return F.lit(1) + F.greatest(
        F.coalesce(F.size("frame_iops"), F.lit(0)), F.coalesce(F.size("frame_ipps"), F.lit(0)), F.lit(0)
    )


def _vectors_of_planes() -> Column:
    """The vectors of a file's planes: its own, then its frames'."""
    none = F.array().cast("array<array<double>>")
    iops, ipps = F.coalesce("frame_iops", none), F.coalesce("frame_ipps", none)
    own = F.struct(F.col("iop").alias("iop"), F.col("ipp").alias("ipp"))
    framed = F.transform(
        F.arrays_zip(iops.alias("iop"), ipps.alias("ipp")),
        lambda f: F.struct(f["iop"].alias("iop"), f["ipp"].alias("ipp")),
    )
    single = (F.size(iops) <= 0) & (F.size(ipps) <= 0)
    return F.when(single, F.array(own)).otherwise(F.concat(F.array(own), framed))


def _attributes() -> Column:
    return F.struct(
        *[tx.blank(F.col(c)).alias(c) for c in _TEXT_ATTRIBUTES],
        F.coalesce("image_type", F.array().cast("array<string>")).alias("image_type"),
        *[F.col(f"`{c}`") for c in _NUMBER_ATTRIBUTES],
        tx.fixed_vector(F.col("pixel_spacing"), 2).alias("pixel_spacing_mm"),
    )


def _unfolded(files: DataFrame, keys: list[str], planes: Column) -> DataFrame:
    """One row per image plane. Only the row of the file itself (``frame`` 0) carries the attributes. Vectors of
    the wrong length are dropped."""
    rows = files.select(*keys, "attributes", F.posexplode(planes).alias("frame", "vectors"))
    iop, ipp = tx.fixed_vector(F.col("vectors.iop"), 6), F.col("vectors.ipp")
    usable = (F.size(ipp) == 3) & all_finite([at(ipp, i) for i in range(3)])
    return rows.select(
        *keys,
        "frame",
        F.when(F.col("frame") == 0, F.col("attributes")).alias("attributes"),
        F.when(F.size(iop) == 6, iop).alias("iop"),
        F.when(usable, ipp).alias("ipp"),
    )


def _frames(keyed: DataFrame) -> DataFrame:
    """One row per image plane: the file's own orientation and position, then its frames'."""
    files = keyed.select(*GROUP_KEYS, "sop_key", _walk().alias("walk"), _attributes().alias("attributes"),
                         _vectors_of_planes().alias("planes"))
    return _unfolded(files, [*GROUP_KEYS, "sop_key", "walk"], F.col("planes"))


def _in_walk_order(present: Column) -> Column:
    return F.when(present, F.struct("walk", "frame"))


def _representative() -> Column:
    """Aggregate: the first complete orientation, valid or not, with its normal."""
    value = F.struct("iop", *[f"normal_{a}" for a in "xyz"])
    return F.min_by(value, _in_walk_order(F.col("iop").isNotNull()))


def _reference() -> Column:
    """Aggregate: the first valid normal."""
    value = F.struct(*[f"normal_{a}" for a in "xyz"])
    return F.min_by(value, _in_walk_order(F.col("normal_x").isNotNull()))


def _parts(struct: str) -> list[Column]:
    return [F.col(struct)[f"normal_{a}"] for a in "xyz"]


def _geometry_terms(df: DataFrame) -> DataFrame:
    """Per image plane: alignment with the reference normal, projection on the slice axis."""
    ipp = [at(F.col("ipp"), i) for i in range(3)]
    return df.withColumns(
        {
            "cosine": F.abs(dot(xyz("normal"), _parts("reference"))),
            "height": dot(ipp, _parts("representative")),
        }
    )


def _geometry() -> list[Column]:
    return [
        F.min("cosine").alias("cosine"),
        F.count("normal_x").alias("n_normals"),
        F.max("height").alias("far"),
        F.min("height").alias("near"),
    ]


def _rollup_together(dealt: DataFrame) -> DataFrame:
    """Series of files (``_keyed``) that are dealt so that a series lies in one task: no exchange, and one sort.

    Files are unfolded into planes first, as the order of rows does not outlive that. Hashes lead the order: a sort that
    begins with a number rarely has to compare texts.
    """
    keys = ["subject_no", "series_no", *GROUP_KEYS]
    files = dealt.select(
        *GROUP_KEYS, "sop_key", _walk().alias("walk"), _attributes().alias("attributes"), _vectors_of_planes().alias("planes"),
    )
    files = files.withColumn("file_no", F.monotonically_increasing_id())
    planes = _unfolded(files, [*GROUP_KEYS, "sop_key", "walk", "file_no"], F.col("planes"))
    numbered = planes.withColumns({"subject_no": F.xxhash64("subject_id"), "series_no": F.xxhash64(*GROUP_KEYS)})
    frames = add_slice_normal(numbered, "iop", "normal")
    # The planes of a file follow each other, so that those of the first copy are told by their places. ``file_no`` only
    # parts files that are equal in all.
    copies = Window.partitionBy(*keys, "sop_key").orderBy("walk", "file_no", "frame")
    known = frames.withColumn("kept", F.row_number().over(copies) == F.col("frame") + 1)
    # A further copy counts, but has no plane of its own.
    shown = known.select(
        *keys, "walk", "frame", "kept", "attributes",
        *[F.when(F.col("kept"), F.col(c)).alias(c) for c in ("iop", "ipp", "normal_x", "normal_y", "normal_z")],
    )
    per_series = Window.partitionBy(*keys)
    placed = shown.withColumns(
        {
            "representative": _representative().over(per_series),
            "reference": _reference().over(per_series),
        }
    )
    own = F.col("frame") == 0
    return _geometry_terms(placed).groupBy(*keys).agg(
        F.min_by("attributes", F.when(own, F.col("walk"))).alias("attributes"),
        F.first("representative").alias("representative"),
        F.count_if(own & F.col("kept")).alias("instance_count"),
        F.count_if(own & ~F.col("kept")).alias("duplicate_instance_count"),
        *_geometry(),
    ).drop("subject_no", "series_no")


def _rollup_spread(keyed: DataFrame) -> DataFrame:
    """The same for a few series of any size: every step pre-aggregates before it shuffles."""
    names = [f"`{c}`" for c in columns(INSTANCES)]
    copies = (
        keyed.groupBy(*GROUP_KEYS, "sop_key")
        .agg(
            F.min_by(F.struct(*names), _walk()).alias("kept"),
            F.count(F.lit(1)).alias("n_copies"),
        )
        .select(*GROUP_KEYS, "sop_key", "n_copies", "kept.*")
    )
    totals = copies.groupBy(*GROUP_KEYS).agg(
        F.count(F.lit(1)).alias("instance_count"),
        (F.sum("n_copies") - F.count(F.lit(1))).alias("duplicate_instance_count"),
    )
    frames = add_slice_normal(_frames(copies), "iop", "normal")
    firsts = frames.groupBy(*GROUP_KEYS).agg(
        F.min_by("attributes", F.when(F.col("frame") == 0, F.col("walk"))).alias("attributes"),
        _representative().alias("representative"),
        _reference().alias("reference"),
    )
    # One row per hot series, and hot_keys() limits their number: safe to broadcast.
    axes = firsts.select(*GROUP_KEYS, "reference", "representative")
    geometry = (
        _geometry_terms(join_null_safe(frames, F.broadcast(axes), GROUP_KEYS))
        .groupBy(*GROUP_KEYS)
        .agg(*_geometry())
    )
    joined = join_null_safe(firsts.drop("reference"), totals, GROUP_KEYS)
    return join_null_safe(joined, geometry, GROUP_KEYS)


def _finish(groups: DataFrame, params: SelectionParams) -> DataFrame:
    """Turn per-series aggregates into the geometry columns of a series."""
    deviation = F.when(F.col("n_normals") >= 2, angle_from_cosine(F.col("cosine"))).when(
        F.col("n_normals") == 1, F.lit(0.0)
    )
    named = groups.select(
        "center",
        "subject_id",
        tx.id_hash(F.col("study_key")).alias("study_uid_hash"),
        tx.id_hash(F.col("series_key")).alias("series_uid_hash"),
        "attributes.*",
        F.col("representative.iop").alias("iop"),
        *[F.col(f"representative.normal_{a}") for a in "xyz"],
        "instance_count",
        "duplicate_instance_count",
        "far",
        "near",
        deviation.alias("deviation"),
    )
    planes = add_plane(named, "normal", params.axial_max_angle_deg, plane="own_plane")
    consistent = F.coalesce(F.col("deviation") <= params.orientation_consistency_deg, F.lit(True))
    thickness = F.greatest(F.coalesce("slice_thickness_mm", F.lit(0.0)), F.lit(0.0))
    return planes.withColumn("orientation_consistent", consistent).withColumns(
        {
            "image_orientation_patient": F.coalesce("iop", F.array().cast("array<double>")),
            "plane": F.when(F.col("orientation_consistent"), F.col("own_plane")).otherwise(
                "inconsistent"
            ),
            "coverage_mm": F.col("far") - F.col("near") + thickness,
            "inventory_note": F.concat_ws(
                ";",
                F.when(F.col("iop").isNull(), "missing_orientation"),
                F.when(
                    ~F.col("orientation_consistent"),
                    F.concat(
                        F.lit("orientation_deviation="), tx.fixed_decimals(F.col("deviation"), 3)
                    ),
                ),
            ),
        }
    ).drop("own_plane", "iop", "normal_x", "normal_y", "normal_z", "deviation", "far", "near")


def series_rollup(
    instances: DataFrame,
    params: SelectionParams = SelectionParams(),
    hot_rows: int | None = HOT_ROWS,
    crowded: DataFrame | None = None,
    buckets: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """One row per (center, subject, study, series) with first-file attributes and geometry.

    Series of at least ``hot_rows`` image planes go through a plan that never gathers them in one
    task. Looking for them is a job of its own over a few columns, of the ``crowded`` subjects only if these are given
    (``crowded_subjects``); ``None`` skips it. Both plans keep
    the same copy of a doubled instance (walk order, then a hash of the row) and let null labels meet,
    so the choice never shows in the result. ``buckets``, without ``hot_rows``, deals whole subjects to so many tasks, for a
    table that is stored like that; it is meant for subjects none of which is large. ``dealt`` says that the
    instances lie like that and name their ``subject_id``, the label of the subject folder: then none moves.
    """
    if hot_rows is None and buckets is not None:
        return _finish(_rollup_together(_by_subject(instances, buckets, dealt)), params)

    def together(rows: DataFrame) -> DataFrame:
        return _rollup_together(rows.repartition(*GROUP_KEYS))

    keyed = _keyed(instances)
    if hot_rows is None:
        return _finish(together(keyed), params)
    among = keyed if crowded is None else join_null_safe(keyed, crowded, ["subject_id"], "left_semi")
    hot = stage(hot_keys(among, GROUP_KEYS, hot_rows, rows=_planes()), "hot-series")
    if hot.isEmpty():
        return _finish(together(keyed), params)
    usual = keyed.join(F.broadcast(hot), null_safe(keyed, hot, GROUP_KEYS), "left_anti")
    large = keyed.join(F.broadcast(hot), null_safe(keyed, hot, GROUP_KEYS), "left_semi")
    return _finish(together(usual).unionByName(_rollup_spread(large)), params)


def series_sources(instances: DataFrame) -> DataFrame:
    """The unique files of every series, one row each (a nested list could grow without bound)."""
    keyed = _keyed(instances)
    first = keyed.groupBy(*GROUP_KEYS, "sop_key").agg(
        F.min_by("relpath", tx.walk_order_key(F.col("relpath"))).alias("source_relpath")
    )
    return first.select(
        "center",
        "subject_id",
        tx.id_hash(F.col("study_key")).alias("study_uid_hash"),
        tx.id_hash(F.col("series_key")).alias("series_uid_hash"),
        "source_relpath",
    ).select(*columns(SERIES_SOURCES))


def classify(series: DataFrame, binary_rounding: bool = False) -> DataFrame:
    """Add type, confidence, source kind and protocol to rolled-up series."""
    facts = series.drop("source_kind", "candidate_type", "classification_confidence", "protocol_id")
    return (
        facts.withColumn("_text", series_text())
        .withColumn("_verdict", candidate(F.col("_text")))
        .select(*facts.columns, source_kind().alias("source_kind"), "_verdict.*")
        .withColumn("protocol_id", protocol_id(binary_rounding))
        .select(*[F.col(f"`{c}`") for c in columns(SERIES)])
    )


def inventory(
    instances: DataFrame,
    params: SelectionParams = SelectionParams(),
    hot_rows: int | None = HOT_ROWS,
    crowded: DataFrame | None = None,
    buckets: int | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Instances to classified series."""
    return classify(series_rollup(instances, params, hot_rows, crowded, buckets, dealt))


def series_order() -> list[Column]:
    """Sort order of the inventory."""
    return [
        F.col("center"),
        F.col("subject_id"),
        F.col("study_uid_hash"),
        F.coalesce("series_number", F.lit(10**9)),
        F.col("series_uid_hash"),
    ]
