"""Alignment of two tokenizers against a plain walk over the bytes."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.llm import alignment, tokens

TEXTS = [
    (1, "The house, the houses and thehouse."), (2, "the house"), (2, "the house"), (None, "naïve ½ 中文 😀 café"),
    (3, None), (4, ""), (5, "▁ a"), (6, "<|endoftext|> <s> <0x41>"), (7, " \n\t double  space "), (8, "the " * 3000),
    (9, "x" * 20_000), (10, "\x00\x01 é"), (11, "a" + " " * 1500 + "b"),
]


@pytest.fixture(scope="module")
def sides():
    return tokens.rank_encoder(tokens.vocabulary_path(tokens.RANKS)), tokens.piece_encoder(tokens.vocabulary_path(tokens.PIECES))


def brute(texts, sides):
    """Rows of the digest, by comparing byte ranges one by one."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    library.encode_special_tokens = True
    bytes_a, bytes_b = (side.token_bytes() for side in sides)
    docs = []
    for doc_id, text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sides[1].library.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, table in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(out)
        links, j = [], 0
        for lo, hi, i in spans[0]:
            while j and spans[1][j - 1][1] > lo:
                j -= 1
            while j < len(spans[1]) and spans[1][j][0] < hi:
                if spans[1][j][1] > lo:
                    links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo < e <= hi) for side in spans))
            lo = hi
        docs.append((doc_id, a, b, groups, links))
    counts = defaultdict(int)
    for *_, links in docs:
        for pair in set(links):
            counts[pair] += 1
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (
            doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, a, b, groups, links in docs
    ]


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block long, key string")


@pytest.mark.parametrize("block_bytes", [16 << 20, 100])
def test_digest(spark, sides, block_bytes):
    got = alignment.digest(table(spark, TEXTS), block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(TEXTS, sides), key=str)
    assert {r["doc_id"]: r["n_a"] for r in got}[5] == 0  # its sign for a space does not come back


def test_an_empty_table(spark):
    assert alignment.digest(table(spark, [])).count() == 0


def test_groups_join_to_the_ids(spark, sides):
    rows = alignment.align(table(spark, [(1, "the house, naïve"), (2, ""), (3, "b c")])).orderBy("doc_id", "place").collect()
    for doc_id, text in ((1, "the house, naïve"), (3, "b c")):
        own = [r for r in rows if r["doc_id"] == doc_id]
        assert [r["place"] for r in own] == list(range(len(own)))
        assert sum((r["a_ids"] for r in own), []) == sides[0].encode([" " + text])[0]
        assert sum((r["b_ids"] for r in own), []) == sides[1].encode([text])[0]
    assert {r["doc_id"] for r in rows} == {1, 3}


def test_pair_counts_cover_all_documents(spark):
    stored = alignment.gathered(table(spark, [(i, "the house") for i in range(40)]), block_bytes=30)
    assert {r["n_docs"] for r in alignment.pair_counts(stored).collect()} == {40}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sé \n\t\x1c .!1<|>½中​", max_size=60))
def test_ranks_give_the_ids_of_the_vocabulary(text):
    ranks = tokens.rank_encoder(tokens.vocabulary_path(tokens.RANKS))
    assert ranks.encode([text])[0] == ranks.other.encode(text, add_special_tokens=False).ids
