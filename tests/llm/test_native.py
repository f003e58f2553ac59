"""Sharding, exact dedup and decontamination against brute force on small tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scanloom.llm import decontamination, exact_dedup, sharding

DOCS = "doc_id long, text string, lang string, _hash string, h string, words int, shard int"


def table(spark, rows, ddl=DOCS):
    width = ddl.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], ddl)


MIXED = [
    (3, "a b c"), (1, "ab  c"), (2, None), (4, ""), (5, " \t\n\x0b\x0c\r"), (None, "ab\nc"), (6, "other"),
    (6, "other"), (7, "Ünïcode text"), (7, "Ünïcodetext"), (8, "x" * 200_000), (9, "x" * 200_000), (10, "abd"),
]


def groups(rows):
    found = {}
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        found.setdefault(key, []).append((-len(text or ""), doc_id is None, doc_id or 0))
    return found


def expected_copies(rows):
    found, out = groups(rows), []
    for key, members in found.items():
        members.sort()
        keep = None if members[0][1] else members[0][2]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [
            (None if none else doc, keep, len(members), at == 0, sha)
            for at, (_, none, doc) in enumerate(members)
        ]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [MIXED, [], [(1, None)], MIXED * 3])
def test_copies_match_brute_force(spark, rows):
    got = exact_dedup.mark_copies(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == expected_copies(rows)
    kept = exact_dedup.drop_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert kept.count() == len(groups(rows))


def test_a_crowd_of_copies_is_cut_and_merged_again(spark):
    rows = [(i, "the same text " + " " * (i % 5)) for i in range(3000)] + [(9000 + i, f"text {i}") for i in range(500)]
    random.Random(3).shuffle(rows)
    docs = table(spark, rows).repartition(6)
    assert sorted(map(tuple, exact_dedup.mark_copies(docs, 16).collect()), key=str) == expected_copies(rows)
    kept = {r["doc_id"] for r in exact_dedup.drop_copies(docs, 16).collect()}
    assert kept == {9000 + i for i in range(500)} | {4}


def test_content_sort_shuffles_texts_once_and_stays_in_the_jvm(spark):
    plan = exact_dedup.mark_copies(table(spark, MIXED))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_shards_are_gapless_and_only_the_new_one_gains(spark):
    rows = [(i, f"text {i}") for i in range(2000)] + [(5, "again"), (5, None), (None, "none"), (None, "none")]
    got = sharding.assign(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert set(by_shard) == set(range(16))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert max(map(len, by_shard.values())) < 1.6 * len(rows) / 16
    assert 0 < sum(r["grown_shard"] == 16 for r in got) < 3 * len(rows) / 17
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    sizes = {(r["doc_id"], r["text_crc32"]): r["size"] for r in got}
    assert sizes[(5, 0)] == 1 and sizes[(7, zlib.crc32(b"text 7"))] == 7


def test_every_further_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    for added in range(4):
        moved = ids.select(
            sharding.shard_of(F.col("doc_id"), sharding.layout(8, added)).alias("a"),
            sharding.shard_of(F.col("doc_id"), sharding.layout(8, added + 1)).alias("b"),
        ).filter("a <> b").select("b").distinct().collect()
        assert [r[0] for r in moved] == [8 + added]


def test_weights_move_rows_only_below_the_changed_node(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    before = sharding.layout(8)
    after = [sharding.Leaf(x.branch, x.rack, x.shard, 3.0 if x.shard == 1 else 1.0) for x in before]
    rows = ids.select(
        sharding.shard_of(F.col("doc_id"), before).alias("a"), sharding.shard_of(F.col("doc_id"), after).alias("b")
    ).collect()
    outside = {x.shard for x in before if x.branch != "region0"}
    assert all(r["a"] == r["b"] for r in rows if r["b"] in outside)
    assert sum(r["b"] == 1 for r in rows) > 1.8 * sum(r["a"] == 1 for r in rows)


def test_an_empty_table_has_no_shards(spark):
    assert sharding.assign(table(spark, [])).count() == 0


LONG = " ".join(f"w{i}" for i in range(25))
ITEMS = [(0, LONG), (1, "short one"), (2, None), (3, "!!"), (10, " ".join(f"W{i}" for i in range(5, 17))), (None, "no id here")]
TEXTS = [
    (1, f"Before. {LONG.upper()}, after"), (2, "a SHORT, one! and short one"), (3, None), (4, ""), (5, "w1 w2 w3"),
    (6, " ".join(f"w{i}" for i in range(9))), (7, "x " * 3_000 + "short\tone"), (8, "Été shorté one"), (2, "a SHORT, one! and short one"),
    (None, "no ID here"), (9, "w5-w6-w7-w8-w9-w10-w11-w12-w13-w14 w15"),
]


def lowered(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def expected_hits(docs, items):
    out = []
    for doc_id, text in docs:
        words, hit, named = lowered(text), set(), set()
        for item, item_text in items:
            own = lowered(item_text)
            n = min(10, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    named |= {str(item)} if item is not None else set()
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(named), sha, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("docs,items", [(TEXTS, ITEMS), (TEXTS, []), ([], ITEMS), (TEXTS, ITEMS[1:2])])
def test_contamination_matches_brute_force(spark, monkeypatch, docs, items):
    benchmark = table(spark, items, "item_id long, text string, doc_id string")
    for bound in (100_000, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", bound)
        got = decontamination.report(table(spark, docs), benchmark)
        assert sorted(map(tuple, got.collect()), key=str) == expected_hits(docs, items)


def test_clean_removes_documents_or_spans(spark):
    docs, benchmark = table(spark, TEXTS), table(spark, ITEMS, "item_id long, text string")
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8]
    cut = {r["doc_id"]: r["text"] for r in decontamination.clean(docs, benchmark, remove="spans").collect()}
    assert len(cut) == 10 and cut[2] == "a , ! and  " and cut[3] is None and cut[5] == "w1 w2 w3"
    assert cut[1].startswith("Before. ") and cut[1].endswith(", after") and "W3" not in cut[1]


def test_decontamination_stays_in_the_jvm(spark):
    got = decontamination.report(table(spark, TEXTS), table(spark, ITEMS, "item_id long, text string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
