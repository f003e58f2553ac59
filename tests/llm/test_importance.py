"""Importance resampling against a version that writes every n-gram out."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.llm import importance

ALPHABET = "Ab1 é-\n中"
TEXTS = [
    (1, "The cat sat, the cat ran." * 9), (2, None), (2, ""), (None, "a b c " * 10), (None, "d " * 25), (3, "--- ... !"),
    (4, "x" * 5000 + " y " + "z" * 90), (5, "ÄÖ ä İ K the_cat " * 8), (6, "cat " * 9000), *[(i, f"cat {i} " * 12) for i in range(10, 60)],
    *[(70, "same row " * 11)] * 6,
]
TARGET = [(1, "The cat sat on the mat"), (2, None), (3, "İ the cat")]


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def grams(text, order):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, order, buckets, min_words, percent):
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    s = Counter(bucket(g) for _, t in docs for g in grams(t, order))
    t = Counter(bucket(g) for _, x in target for g in grams(x, order))
    in_s, in_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        found = grams(text, order)
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (in_s + buckets) / ((s[b] + 1) * (in_t + buckets))))
            for b in map(bucket, found)
        ]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words(text))])
    fit = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], r[1], r[2]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def table(spark, rows, name="doc_id"):
    return spark.createDataFrame([(d, t, "x", 3) for d, t in rows], f"{name} long, text string, weight string, bucket long")


@pytest.mark.parametrize("order,segment_bytes,percent", [(1, 4 << 20, 10), (1, 40, 50), (3, 4 << 20, 50), (3, 40, 100)])
def test_resample(spark, order, segment_bytes, percent):
    got = importance.resample(
        table(spark, TEXTS), table(spark, TARGET, "item_id"), order, 1000, 20, percent, segment_bytes=segment_bytes
    ).collect()
    assert sorted(map(tuple, got), key=str) == brute(TEXTS, TARGET, order, 1000, 20, percent)


def test_many_buckets(spark):
    got = importance.resample(table(spark, TEXTS), table(spark, TARGET, "item_id"), 2, 100_000).collect()
    assert sorted(map(tuple, got), key=str) == brute(TEXTS, TARGET, 2, 100_000, 20, 10)


def test_empty_tables(spark):
    assert importance.resample(table(spark, []), table(spark, TARGET, "item_id")).count() == 0
    got = importance.resample(table(spark, TEXTS), table(spark, [], "item_id")).collect()
    assert sorted(map(tuple, got), key=str) == brute(TEXTS, [], 1, 10_000, 20, 10)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=4), st.integers(1, 4))
def test_composed_sums_are_those_of_written_grams(texts, order):
    normal = [(i, t.encode().translate(importance.NORMAL)) for i, t in enumerate(texts)]
    rows, crcs = importance.composed(*importance.payloads(normal), order)
    wanted = Counter((i, zlib.crc32(g.encode())) for i, t in enumerate(texts) for g in grams(t, order))
    assert Counter(zip(rows.tolist(), crcs.tolist())) == wanted


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=300))
def test_joined_crc(a, b):
    got = importance.joined_crc(*(np.array([x], np.uint32) for x in (zlib.crc32(a), zlib.crc32(b))), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)
