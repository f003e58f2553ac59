"""The attention model against plain loops and numeric gradients, and its scores against brute-force counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from scanloom.llm import attention as model
from scanloom.llm import attention_lm, blocks, tokens

TEXTS = [
    (0, "the cat sat on the mat. " * 30), (1, "the dog sat on the log. " * 30), (2, None), (2, ""), (None, "The cat\tand the dog"),
    (3, "Ünï çode 日本 ½ THE the"), (4, "word " * 3000), (5, "x" * 9000), (6, "zebra crossing the unseen"), (7, "the cat sat on the mat. " * 3),
    *[(i, f"the cat number {i} sat on the log and the mat") for i in range(8, 40)],
]
DDL = "doc_id long, text string, block long, n_tokens string, key long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], DDL)


@pytest.fixture
def small():
    rng = np.random.default_rng(1)
    n = 60
    classes = rng.integers(0, model.CLASSES, n)
    members, share, prior, inner = model.token_members(rng.integers(0, 9, n).astype(float), classes)
    weights = rng.normal(0, 0.3, model.SIZE).astype(np.float32)
    return model.Model(rng.normal(size=(n, model.VECTOR)).astype(np.float32), classes, members, share, weights, 0)


def chances(m, history):
    """The chance of every id after a list of inputs, written out one query at a time."""
    p = {k: v.astype(float) for k, v in model.parts(m.weights).items()}
    asking = m.vectors[history[-1]].astype(float)
    scores = []
    for back, i in enumerate(history[::-1]):
        scores.append((asking @ p["query"]) @ (m.vectors[i] @ p["key"]) / math.sqrt(model.KEY) + p["distance"][back])
    weight = np.exp(scores) / np.exp(scores).sum()
    seen = sum(w * (m.vectors[i] @ p["value"]) for w, i in zip(weight, history[::-1]))
    hidden = np.maximum(asking @ p["own"] + seen @ p["seen"] + p["shift"], 0)
    by_class = np.exp(hidden @ p["out"] + p["prior"])
    by_class /= by_class.sum()
    out = np.zeros(len(m.classes))
    for i, (c, member) in enumerate(zip(m.classes, m.members)):
        inner = np.exp(hidden @ p["inner"][c] + p["inner_prior"][c])
        out[i] = by_class[c] * inner[member] / inner.sum() * math.exp(m.share[i])
    return out


def test_scores_are_those_of_plain_loops(small):
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, 60, n), 0) for n in (0, 1, 15, 16, 17, 70)]
    got = model.Scorer(small).texts(texts)
    for text, found in zip(texts, got):
        inputs, total = [0, *text[:-1]], 0.0
        for at in range(len(text)):
            start = max(0, at // model.STEP * model.STEP - model.STEP)
            total += math.log10(chances(small, inputs[start : at + 1])[text[at]])
        assert found == pytest.approx(total, rel=1e-4)


def test_chances_sum_to_one(small):
    present = set(zip(small.classes.tolist(), small.members.tolist()))
    p = model.parts(small.weights)
    for c in range(model.CLASSES):  # classes and members without ids have no chance to give away here
        for m in range(model.MEMBERS):
            if (c, m) not in present:
                p["inner_prior"][c, m] = -1e3
        if c not in small.classes:
            p["prior"][c] = -1e3
    assert chances(small, [0, 5, 7]).sum() == pytest.approx(1, abs=1e-6)


def test_every_token_is_a_target_once():
    texts = [np.arange(1, n + 1) for n in (1, 16, 33, 5)]
    inputs, targets, counted, first, text = model.windows(texts, 0)
    for at, wanted in enumerate(texts):
        assert targets[text == at][counted[text == at] > 0].tolist() == wanted.tolist()
    assert first.sum() == len(texts)
    later = ~first
    assert (inputs[later][:, : model.STEP] == np.roll(inputs, 1, 0)[later][:, model.STEP :]).all()


def test_gradient(small):
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(1, 60, n), 0) for n in (3, 40, 25)]
    inputs, targets, counted, first, _ = model.windows(texts, 0)
    weights = small.weights.astype(float)
    _, found = model.gradient(small, weights, inputs, targets, counted, first)
    for k in [*rng.integers(0, model.SIZE, 20), *rng.integers(0, 3000, 20)]:
        moved = np.zeros(model.SIZE)
        moved[k] = 1e-6
        up, down = (model.gradient(small, weights + s * moved, inputs, targets, counted, first)[0] for s in (1, -1))
        assert found[k] == pytest.approx((up - down) / 2e-6, abs=1e-4, rel=1e-2)


def test_learning_lowers_the_loss(small):
    texts = [np.array([5, 9, 3, 0] * 50 + [0])] * 4
    inputs, targets, counted, first, _ = model.windows(texts, 0)
    run = model.Adam(small.weights)
    losses = []
    for _ in range(60):
        loss, step = model.gradient(small, run.weights, inputs, targets, counted, first)
        losses.append(loss)
        run.step(step)
    assert losses[-1] < 0.3 * losses[0]


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


@pytest.mark.parametrize("block_bytes", [blocks.BLOCK_BYTES, 200])
def test_scores(spark, block_bytes):
    got = attention_lm.score(table(spark, TEXTS), block_bytes=block_bytes, share=1).collect()
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in TEXTS}
    counts = Counter(w for d, t in TEXTS if not held[d] for w in words(t))
    n, v = sum(counts.values()), len(counts)
    assert any(held.values())
    wanted = sorted((
        (d, held[d], len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6))
        for d, t in TEXTS
    ), key=str)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=str) == wanted
    assert all(r["score"] < 0 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[8]["score"] / 9 > by_id[6]["score"] / 4  # what was learned from is likelier than what is new
    same = [r["score"] for r in got if r["doc_id"] == 2]
    assert same[0] == pytest.approx(same[1])


def test_learned_text_scores_better_than_counts_of_ids(spark):
    stored = attention_lm.gathered(table(spark, TEXTS))
    learned = attention_lm.learn(stored, share=1)
    plain = attention_lm.learn(stored, rounds=0)
    ranks = tokens.rank_encoder(tokens.vocabulary_path(tokens.RANKS))
    text = [np.array([*ranks.encode(["the dog sat on the log. the cat sat on the mat."])[0], attention_lm.END])]
    assert model.Scorer(learned).texts(text)[0] > model.Scorer(plain).texts(text)[0]


def test_tables_without_training_rows(spark):
    assert attention_lm.score(table(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = attention_lm.score(table(spark, [(only, "a b")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert math.isfinite(row["score"])
