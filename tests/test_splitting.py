"""One file read by many tasks gives what a whole-file reader gives."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_inventory import SMALL

from scanloom.plans import queries_io
from scanloom.sources import readers, splitting, writers


@pytest.fixture
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


CELLS = ["plain", "", " spaced ", 'say "hi"', "two\nlines", "tab\there", '"', "\n\n", 'a"b\n"c', "é中", "\n" * 40, 'x"\n\t"y', "5", "r\r\nn"]


def _same(spark, path):
    whole = readers.read_tsv(spark, path, split=False)
    cut = readers.read_tsv(spark, path, split=True)
    assert cut.columns == whole.columns
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))
    return cut


@pytest.mark.parametrize("seed", range(3))
def test_a_table_with_line_breaks_in_cells(spark, small_blocks, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"k{i}", *rng.choices(CELLS, k=3)) for i in range(400)]
    table = spark.createDataFrame(rows, "key STRING, a STRING, b STRING, c STRING").coalesce(1)
    writers.write_tsv(table, str(tmp_path / "t"), ["key", "a", "b", "c"])
    cut = _same(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, cut.collect())) == sorted(rows)
    assert readers.read_tsv(spark, str(tmp_path / "t")).exceptAll(cut).count() == 0  # the usual call cuts it too
    pieces = splitting.text_pieces(spark, str(tmp_path / "t"), "\n")
    assert pieces.select(F.spark_partition_id()).distinct().count() > 10
    ordered = readers.read_tsv(spark, str(tmp_path / "t"), "place", split=True).orderBy("place").select("key").collect()
    assert [r.key for r in ordered] == [r[0] for r in rows]


def test_hand_written_tables(spark, small_blocks, tmp_path):
    (tmp_path / "a.tsv").write_text("﻿key\tnote\r\n1\tplain 5\" disk\r\n\r\n2\t\"two\r\nlines\"\r\n3\t\r\n" + "4\tx\n" * 300, newline="")
    (tmp_path / "b.tsv").write_text("key\tnote\n9\t\"last\n\n\"\"one\"\"\"", newline="")
    got = sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / "*.tsv"), split=True).collect()))
    assert got == sorted([("1", 'plain 5" disk'), ("2", "two\r\nlines"), ("3", "")] + [("4", "x")] * 300 + [("9", 'last\n\n"one"')])


def test_empty_tables(spark, tmp_path):
    (tmp_path / "head.tsv").write_text("key\tnote\n")
    assert readers.read_tsv(spark, str(tmp_path / "head.tsv"), split=True).count() == 0
    assert readers.read_tsv(spark, str(tmp_path / "head.tsv"), split=True).columns == ["key", "note"]


@pytest.mark.parametrize("indent", [None, 2])
def test_an_array_of_series(spark, small_blocks, tmp_path, indent):
    texts = ["plain", "} ]", '"{', "back\\slash", "\\\"", "line\nbreak", "é{中}", ""]
    rng = random.Random(7)
    objects = [
        {"center": "a", "subject_id": f"s{i}", "study_uid_hash": rng.choice(texts), "series_uid_hash": f"h{i}",
         "image_type": rng.choices(texts, k=2), "source_relpaths": [f"{i}/{j}" for j in range(i % 3)],
         "extra": rng.choice([{}, {"x": {"y": "}"}}, [], [[1], [{}]], 3])}
        for i in range(200)
    ]
    (tmp_path / "s.json").write_text(json.dumps(objects, indent=indent, ensure_ascii=False))
    whole, cut = (readers.read_series_json(spark, str(tmp_path / "s.json"), split=s) for s in (False, True))
    for a, b in zip(whole, cut):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert cut[0].count() == 200
    assert splitting.text_pieces(spark, str(tmp_path / "s.json"), "}").select(F.spark_partition_id()).distinct().count() > 5


def test_texts_move_once_to_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    for at in range(40):
        (tmp_path / f"{at}.json").write_text(json.dumps([{"center": f"{at}}}", "subject_id": '\\"'}] * 50))
    monkeypatch.setattr(splitting, "SORT_BYTES", 1000)
    found = splitting.json_elements(spark, f"{tmp_path}/*.json")
    plan = found._jdf.queryExecution().executedPlan().toString()
    tasks = {int(n) for n in re.findall(r"hashpartitioning\(_file#\d+, _block#\d+L, (\d+)\), REPARTITION", plan)}
    assert min(tasks) > 50  # about 1,700 bytes in each of 40 files
    assert found.count() == 2000


def test_arrays_of_series_are_written_small(spark):
    made = queries_io.series_json_pieces(spark, SMALL)
    written = [f for f in made.inputFiles() if "/series-arrays-" in f]
    assert made.count() > 0 and written and all(f.endswith(".gz") for f in written)


def test_arrays_without_objects(spark, tmp_path):
    for i, text in enumerate(("[]", " [ ]\n", "")):
        (tmp_path / f"{i}.json").write_text(text)
    assert splitting.json_elements(spark, str(tmp_path / "*.json")).count() == 0


def test_no_group_of_pieces_grows_with_the_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"center": "a", "image_type": ["x"]}] * 50))
    numbered = splitting.json_elements(spark, str(tmp_path / "s.json"))
    assert numbered.count() == 50


def test_folders_are_walked_level_by_level(spark, tmp_path):
    for name in ("a/b/c/1.txt", "a/2.txt", "3.txt", "a/b/é 4"):
        place = tmp_path / "root" / name
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(name)
    (tmp_path / "root" / "link").symlink_to(tmp_path / "root" / "a", target_is_directory=True)
    (tmp_path / "root" / "empty").mkdir()
    got = {(r.relpath, r.length) for r in readers.walked_listing(spark, str(tmp_path / "root")).collect()}
    assert got == {(n, len(n.encode())) for n in ("a/b/c/1.txt", "a/2.txt", "3.txt", "a/b/é 4")}
    same = {(r.relpath, r.length, r.mtime) for r in readers.file_listing(spark, str(tmp_path / "root" / "a")).collect()}
    walked = {(r.relpath, r.length, r.mtime.replace(microsecond=r.mtime.microsecond // 1000 * 1000)) for r in readers.walked_listing(spark, f"file://{tmp_path}/root/a").collect()}
    assert {s[:2] for s in same} == {w[:2] for w in walked} and {s[2] for s in same} == {w[2] for w in walked}


def test_large_files_are_digested_in_blocks(spark, tmp_path):
    import hashlib

    with open(tmp_path / "large", "wb") as file:
        file.truncate((1 << 31) + 12_345)  # sparse, and more than one value can hold
    (tmp_path / "small").write_bytes(b"abc")
    total = hashlib.sha256()
    left = (1 << 31) + 12_345
    while left:
        n = min(left, 1 << 24)
        total.update(bytes(n))
        left -= n
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in readers.fixity(spark, str(tmp_path)).collect()}
    assert got == {"large": total.hexdigest(), "small": hashlib.sha256(b"abc").hexdigest()}


def test_a_log_and_a_report_that_are_not_there(spark, tmp_path):
    assert [r.json for r in readers.read_reports(spark, str(tmp_path / "none.json")).collect()] == [None]
    (tmp_path / "log.tsv").write_text("ts\tdisk_write_bytes_per_second\n1\t5\n2\tx\n3\t7.5\n")
    row = readers.read_latest_rates(spark, str(tmp_path / "log.tsv")).first()
    assert tuple(row) == (7.5, None, None)
    (tmp_path / "head.tsv").write_text("ts\tdisk_write_bytes_per_second\n")
    assert readers.read_latest_rates(spark, str(tmp_path / "head.tsv")).count() == 0
