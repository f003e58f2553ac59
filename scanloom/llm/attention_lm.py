"""Log chances of whole texts by a causal self-attention model over subword ids, beside a count of words.

Texts are encoded once. All training documents give the counts of ids, of what stands beside them, and of words;
from these come the vectors, classes and shares of ``attention.Model``, whose few thousand weights are then learned
in rounds: every task takes Adam steps over a share of the windows of its training documents, starting from the
same weights, and the results are averaged by the number of tokens. The rounds' shares are all windows, each once.
Scoring reads every document in overlapping windows of which each token is
scored once. Word counts are summed over the corpus and go back to blocks of documents (``blocks``).
"""

from __future__ import annotations

import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import attention, blocks
from scanloom.llm.attention import Adam, Model, Scorer, gradient, windows
from scanloom.llm.common import texts_of
from scanloom.llm.tokens import RANKS, rank_encoder, vocabulary_path
from scanloom.operators.staging import stage

#: Ids of the vocabulary and the free one that closes a text.
IDS, END = 50_257, 50_256
#: Sides of a token are counted in so many buckets of ids; the first half are the most frequent ids, one each.
SIDES = 32
#: Rounds of learning, in each of which one window in ``SHARE`` is learned from, another one each time: as many
#: rounds as that learn from every window once.
ROUNDS, SHARE = 2, 2
#: Bytes of text in a block; its distinct words are held by the task.
BLOCK_BYTES = 16 << 20
#: Weights in one row of a task's result.
CHUNK = 4096
#: A-Z in lower case.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The key of the end of a text among words, which are never empty.
END_WORD = ""

FACTS = "at int, doc_id long, held_out boolean, n_tokens long, ids binary"
#: Times of an id in a task's training documents, in rows of their own.
ID_TIMES = "id int, id_times long"
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a seventh, by a checksum of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def gathered(docs: DataFrame, ranks: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored table of ``blocks``: documents with their ids and words, and the words of every block with their
    times in its training documents."""
    ranks = ranks or vocabulary_path(RANKS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = TaskContext.get().partitionId() * blocks.PARTITION_STRIDE
        place: defaultdict[bytes, int] = defaultdict()
        place.default_factory = place.__len__
        id_times = np.zeros(IDS, np.int64)
        partial = np.zeros(1 << 16, np.int64)
        size = rows = 0

        def listed() -> Iterator[dict]:
            words = pa.array(list(place), pa.binary()).cast(pa.string())
            return blocks.dictionary_rows(block, words, np.arange(len(words)), partial)

        for piece in blocks.slices(batches):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            ids = [array.array("H", [*found, END]).tobytes() for found in rank_encoder(ranks).encode(texts)]
            words = [[*text.encode().translate(LOWER).split(), b""] for text in texts]
            n_tokens = np.fromiter(map(len, words), np.int64, len(words))
            places = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64, n_tokens.sum())
            keys, times = np.unique(np.repeat(np.arange(len(texts)) << 32, n_tokens) | places, return_counts=True)
            if len(place) > len(partial):
                partial = np.concatenate([partial, np.zeros(max(len(partial), len(place)), np.int64)])
            learned_from = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            np.add.at(id_times, np.frombuffer(b"".join(compress(ids, learned_from)), "<u2"), 1)
            mine = learned_from[keys >> 32]
            np.add.at(partial, keys[mine] & 0xFFFFFFFF, times[mine])
            yield {
                "block": [block] * len(texts), "at": np.arange(rows, rows + len(texts)), "doc_id": piece.column("doc_id"), "held_out": piece.column("held_out"),
                "n_tokens": n_tokens, "ids": ids,
            } | blocks.stepped(keys, times, len(texts))
            size, rows = size + piece.column("text").nbytes, rows + len(texts)
            if size >= block_bytes:
                yield from listed()
                place.clear()
                partial[:] = 0
                size, rows, block = 0, 0, block + 1
        if place:
            yield from listed()
        seen = np.flatnonzero(id_times)
        yield {"id": seen, "id_times": id_times[seen]}

    rows = texts_of(docs).withColumn("held_out", held_out(F.col("doc_id")))
    schema = f"{FACTS}, {blocks.DOCUMENT}, {blocks.DICTIONARY.format(key='string')}, {ID_TIMES}"
    return stage(blocks.map_rows(rows, work, schema), "scored-texts")


def _texts(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(value.as_buffer(), "<u2").astype(np.int64) for value in batch.column("ids")]


def _ids(stored: DataFrame, training: bool = True) -> DataFrame:
    rows = blocks.documents(stored).filter(F.col("id").isNull())
    return rows.filter(~F.col("held_out")).select("ids") if training else rows


def _counted(rows: DataFrame, keys, size: int) -> np.ndarray:
    """How often each key below ``size`` occurs; ``keys`` makes them of a text's ids. One partial row per key and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = _texts(batch.slice(at, 256))
                for found in keys(texts):
                    np.add.at(n, found, 1)
        at = np.flatnonzero(n)
        yield {"key": at, "n": n[at]}

    return _dense(blocks.map_rows(rows, work, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")), size)


def _dense(counts: DataFrame, size: int) -> np.ndarray:
    """Counts by key as an array, as long as the vocabulary or that times its sides."""
    summed = counts.toArrow()
    out = np.zeros(size, np.int64)
    out[summed.column("key").to_numpy()] = summed.column("n").to_numpy()
    return out


def side_buckets(n: np.ndarray, sides: int = SIDES) -> np.ndarray:
    """The bucket of each id: one of its own for the most frequent, the others are dealt in turn."""
    out = np.empty(len(n), np.int64)
    place = np.arange(len(n))
    out[np.lexsort((place, -n))] = np.where(place < sides // 2, place, sides // 2 + place % (sides - sides // 2))
    return out


def learn(stored: DataFrame, rounds: int = ROUNDS, share: int = SHARE) -> Model:
    """The model of all training documents of a stored table (``gathered``)."""
    rows = _ids(stored)
    n = _dense(stored.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("key")).agg(F.sum("id_times").alias("n")), IDS)
    bucket = side_buckets(n)

    def sides(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
        here = np.concatenate(texts)
        first = np.zeros(len(here), bool)
        first[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
        before = np.where(first, END, np.roll(here, 1))
        yield np.concatenate([before * (2 * SIDES) + bucket[here], here * (2 * SIDES) + SIDES + bucket[before]])

    beside = _counted(rows, sides, IDS * 2 * SIDES).reshape(IDS, 2, SIDES)
    classes = attention.token_classes(n, beside[:, 1])
    members, share_in, prior, inner_prior = attention.token_members(n, classes)
    vectors = attention.token_vectors(beside[:, 0], beside[:, 1])
    model = Model(vectors, classes, members, share_in, attention.first_weights(prior, inner_prior), END)
    for number in range(rounds):
        model.weights = learned(rows, model, number, share)
    return model


def learned(rows: DataFrame, model: Model, number: int, share: int) -> np.ndarray:
    """The weights after a round of local steps in every task, averaged by tokens; as they were without any window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        run, seen, at = Adam(model.weights), 0.0, number % share
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def step() -> None:
            nonlocal seen, waiting, held
            inputs, targets, counted, first = (np.concatenate(part) for part in zip(*waiting))
            run.step(gradient(model, run.weights, inputs, targets, counted, first)[1])
            seen += float(counted.sum())
            waiting, held = [], 0

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                inputs, targets, counted, first, _ = windows(_texts(batch.slice(start, 64)), model.end)
                mine = np.arange(at, len(inputs), share)
                at = (at - len(inputs)) % share
                for lo in range(0, len(mine), attention.TRAIN_WINDOWS):
                    part = mine[lo : lo + attention.TRAIN_WINDOWS]
                    waiting.append((inputs[part], targets[part], counted[part], first[part]))
                    held += len(part)
                    if held >= attention.TRAIN_WINDOWS:
                        step()
        if waiting:
            step()
        if seen:
            held = np.append(run.weights.astype(np.float64) * seen, seen)
            chunks = [held[at : at + CHUNK].tobytes() for at in range(0, len(held), CHUNK)]
            yield {"chunk": np.arange(len(chunks)), "sums": chunks}

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(value.as_buffer()) for value in rows.column("sums"))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    made = blocks.map_rows(rows, work, "chunk int, sums binary").groupBy("chunk").applyInArrow(added, "chunk int, sums binary")
    # As long as the weights, and empty where no task had a window.
    sums = np.frombuffer(b"".join(row["sums"] for row in sorted(made.collect())))
    return (sums[:-1] / sums[-1]).astype(np.float32) if len(sums) else model.weights


def scored(stored: DataFrame, model: Model) -> DataFrame:
    """block, at (which name a document of a stored table), its facts and ``score``, the model's log10 chance of the
    whole text and its end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = Scorer(model)
        for batch in batches:
            for piece in blocks.slices([batch], "ids", blocks.SLICE_BYTES):
                kept = {c: piece.column(c) for c in piece.schema.names if c != "ids"}
                yield kept | {"score": scorer.texts(_texts(piece))}

    told = "block long, at int, doc_id long, held_out boolean, n_tokens long"
    rows = _ids(stored, training=False).select(*[f.split()[0] for f in told.split(", ")], "ids")
    return blocks.map_rows(rows, work, f"{told}, score double")


def score(docs: DataFrame, ranks: str | None = None, block_bytes: int = BLOCK_BYTES, rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens (words and an end), n_known (those that training
    documents have), train_tokens (of all training documents), base_score (log10 of smoothed word frequencies), score
    (log10 chance by the model).

    Texts of any length are scored whole. A null or empty text is its end alone. Repeated rows are documents of
    their own; a null doc_id stays null and is learned from; other columns are ignored; an empty table gives no
    rows. Without training documents every word is unknown and the model is uniform over ids within equal classes.
    """
    stored = gathered(docs, ranks, block_bytes)
    model = learn(stored, rounds, share)
    totals = stage(blocks.totals(stored), "word-totals")
    facts = totals.agg(F.sum("total").alias("tokens"), F.count_if(F.col("total") > 0).alias("words")).first()
    tokens, words = facts["tokens"] or 0, facts["words"]

    def summed(both: pa.Table, told: pa.Table) -> pa.Table:
        # A document comes as two rows: one with its words, one with its score.
        words_of, rows = (both.filter(f(both.column("score"))).sort_by("at") for f in (pc.is_null, pc.is_valid))
        n = blocks.looked_up(told, "total")
        logs = np.log10((n + 1.0) / (tokens + words + 1.0))
        known, base = [], []
        for steps, times in zip(words_of.column("steps").to_pylist(), words_of.column("times").to_pylist()):
            places, often = blocks.places_of(steps), np.frombuffer(times, "<u4").astype(np.int64)
            known.append(int(often[n[places] > 0].sum()))
            base.append(float((logs[places] * often).sum()))
        made = rows.append_column("n_known", pa.array(known, pa.int64())).append_column(
            "base_score", pa.array(base, pa.float64())
        ).append_column("train_tokens", pa.array([tokens] * len(rows), pa.int64()))
        return made.select([f.split()[0] for f in RESULT.split(", ")])

    counted = _ids(stored, training=False).select("block", "at", "steps", "times")
    both = counted.unionByName(scored(stored, model), allowMissingColumns=True)
    return blocks.returned(both, stored, totals, summed, RESULT)
