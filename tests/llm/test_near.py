"""Near-duplicate components and the pipeline against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from scanloom.llm import components, simhash, vantage
from scanloom.llm.common import table as read

DOCS = "doc_id long, text string, lang string, source string, fp string, head string, tree int"


def table(spark, rows, ddl=DOCS):
    width = ddl.count(",") + 1
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], ddl)


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\x09\x0a\x0b\x0c\x0d":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_labels(fps, radius=4):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def crowd(seed, n):
    """Fingerprints around a few centres, some near each other, and scattered ones."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    centres.append(centres[0] ^ sum(1 << b for b in rng.sample(range(64), 7)))
    out = {rng.getrandbits(64) for _ in range(n // 4)}
    while len(out) < n:
        flips = rng.sample(range(64), rng.randint(0, 6))
        out.add(rng.choice(centres) ^ sum(1 << b for b in flips))
    out = list(out)
    rng.shuffle(out)
    return np.array(out, np.uint64)


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two  three", "a b c d", "É x\x0by\x0cz é A " * 9, "w\x85x\xa0y z q r s t"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("seed,leaf,block", [(1, 4, 64), (2, 8, 1 << 20), (3, 192, 1 << 20), (4, 2, 16)])
def test_vantage_tree_finds_the_groups(monkeypatch, seed, leaf, block):
    monkeypatch.setattr(vantage, "LEAF", leaf)
    monkeypatch.setattr(vantage, "BLOCK", block)
    fps = crowd(seed, 400)
    assert vantage.groups_within(fps, 4).tolist() == slow_labels(fps)


@pytest.mark.parametrize("pieces,shard_rows", [(5, 20_000), (5, 25), (6, 20_000), (8, 40)])
def test_links_keep_every_component(spark, pieces, shard_rows):
    fps = crowd(pieces, 500)
    reps = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.near_links(reps, pieces, shard_rows)).collect()}
    got, wanted = {}, {}
    for fp, label in zip(fps.view(np.int64).tolist(), slow_labels(fps)):
        got.setdefault(roots.get(fp, fp), set()).add(fp)
        wanted.setdefault(label, set()).add(fp)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_pieces_must_leave_one_untouched():
    with pytest.raises(ValueError):
        simhash.piece_masks(4)
    for pieces in (5, 6, 7):
        masks = simhash.piece_masks(pieces)
        rng = random.Random(pieces)
        for _ in range(200):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flipped & m for m in masks)


def documents():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(1, 900))]
        rows.append((i, " ".join(own)))
        for k in range(rng.choice([0, 0, 1, 3])):
            changed = list(own)
            changed[rng.randrange(len(own))] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(changed) if k else "  ".join(own)))
    return [*rows, (2000, None), (1999, ""), (None, " "), (None, "lonely words of no id"), (5, rows[0][1]), (5, rows[0][1])]


def test_components_table(spark):
    rows = documents()
    got = simhash.components_of(table(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    labels = slow_labels(fps)
    least = {}
    for label, (doc, _) in zip(labels, rows):
        if doc is not None:
            least[label] = min(doc, least.get(label, doc))
    wanted = [(d, f"{fp:016x}", least.get(label)) for (d, _), fp, label in zip(rows, fps, labels)]
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert simhash.components_of(table(spark, [])).count() == 0


def test_one_document_of_each_component_stays(spark):
    rows = [r for r in documents() if r[0] != 5]
    kept = simhash.drop_near_copies(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    labels = slow_labels([slow_fingerprint(t) for _, t in rows])
    wanted = {}
    for label, (doc, _) in zip(labels, rows):
        wanted.setdefault(label, []).append((doc is None, doc or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(map(min, wanted.values()))


def test_components_of_long_paths(spark):
    rng = random.Random(9)
    edges, wanted = [], {}
    for start, n in ((0, 40), (100, 2), (200, 300)):
        nodes = list(range(start, start + n))
        order = nodes[:]
        rng.shuffle(order)
        edges += list(zip(order, order[1:]))
        wanted.update(dict.fromkeys(nodes, start))
    edges += [(500, 500), (0, 1), (1, 0)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == wanted and len(got) == len(wanted)


def test_pipeline_stage_by_stage(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = read(spark, sf_dir, "documents")
    benchmark = read(spark, sf_dir, "benchmark").collect()
    rows = docs.collect()
    assert len(corpus_pipeline.STAGES) == 5
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stage(step(spark, docs, sf_dir), name)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: {r["doc_id"] for r in found} for name, found in kept.items()}
    assert len(ids["language"]) >= 0.99 * len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows}
    heads = {}
    for i in ids["language"]:
        key = "".join(texts[i].split())
        heads[key] = min(heads.get(key, (0, 0)), (-len(texts[i]), i)) if key in heads else (-len(texts[i]), i)
    assert ids["exact_copies"] == {i for _, i in heads.values()}
    order = sorted(ids["exact_copies"])
    labels = slow_labels([simhash.fingerprint(texts[i]) for i in order])
    assert ids["near_copies"] == {order[i] for i in set(labels)}
    from test_native import expected_hits

    judged = expected_hits([(i, texts[i]) for i in ids["near_copies"]], [(b["item_id"], b["text"]) for b in benchmark])
    assert ids["benchmarks"] == {r[0] for r in judged if not r[5]}
    assert ids["packing"] == ids["benchmarks"]
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept["packing"])
