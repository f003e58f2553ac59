"""The attention model: windows of token ids, the forward pass, gradients and Adam, all in numpy.

A token's vector, from counts of its neighbours, gives its key, value and query. A query attends to the keys before
it in its window with a learned bias for their distance; a hidden layer of the token's own vector and what it
attended to gives the class of the next token, and its member of that class. The most frequent ids of a class are
members of their own; the others share the last member by their frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Tokens that a window scores; as many stand before them as context.
STEP = 16
WINDOW = 2 * STEP
#: Widths of token vectors, keys and the hidden layer.
VECTOR, KEY, HIDDEN = 24, 8, 24
CLASSES, MEMBERS = 32, 32
#: Windows that attend together, windows whose members are told together, and windows of one step of training.
SCORE_WINDOWS, MEMBER_WINDOWS, TRAIN_WINDOWS = 512, 8192, 128
RATE = 0.02
FAR = np.float32(-1e9)
#: Scores of keys and logits count as between these, so that exponentials are finite and sums are not zero.
LEAST, MOST = np.float32(-40), np.float32(40)

SHAPES = {
    "query": (VECTOR, KEY), "key": (VECTOR, KEY), "value": (VECTOR, KEY), "distance": (WINDOW,),
    "own": (VECTOR, HIDDEN), "seen": (KEY, HIDDEN), "shift": (HIDDEN,), "out": (HIDDEN, CLASSES), "prior": (CLASSES,),
    "inner": (CLASSES, HIDDEN, MEMBERS), "inner_prior": (CLASSES, MEMBERS),
}
SIZE = sum(int(np.prod(shape)) for shape in SHAPES.values())

#: How far back each key lies from each query; negative ones are later and masked.
BACK = STEP + np.arange(STEP)[:, None] - np.arange(WINDOW)[None, :]


@dataclass
class Model:
    """Vectors (one row per id), class, member and log share in that member of each id, weights, the id of an end."""

    vectors: np.ndarray
    classes: np.ndarray
    members: np.ndarray
    share: np.ndarray
    weights: np.ndarray
    end: int


def parts(weights: np.ndarray) -> dict[str, np.ndarray]:
    """The named arrays in one vector of weights; views, so that changing them changes it."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = weights[at : at + n].reshape(shape)
        at += n
    return out


def first_weights(prior: np.ndarray, inner_prior: np.ndarray, seed: int = 0) -> np.ndarray:
    """Small random weights whose model gives every class and member its prior log chance."""
    weights = np.random.default_rng(seed).normal(0, 0.2, SIZE).astype(np.float32)
    p = parts(weights)
    p["distance"][:] = 0
    p["shift"][:] = 0
    p["out"][:] = 0
    p["prior"][:] = prior
    p["inner"][:] = 0
    p["inner_prior"][:] = inner_prior
    return weights


def windows(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs [n, WINDOW], targets [n, STEP], which targets count, whether a window is its text's first, its text.

    ``texts`` are ids that close with ``end``; the input before the first token is ``end`` as well. Windows
    overlap by STEP inputs, and every token of a text is the target of exactly one window.
    """
    chunks = np.array([-(-len(t) // STEP) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(chunks)])
    n = int(starts[-1])
    inputs = np.full((n, STEP), end, np.int64)
    targets = np.full((n, STEP), end, np.int64)
    flat_in, flat_out, counted = inputs.reshape(-1), targets.reshape(-1), np.zeros(n * STEP, np.float32)
    for text, start in zip(texts, starts[:-1] * STEP):
        flat_in[start + 1 : start + len(text)] = text[:-1]
        flat_out[start : start + len(text)] = text
        counted[start : start + len(text)] = 1
    first = np.zeros(n, bool)
    first[starts[:-1][chunks > 0]] = True
    before = np.roll(inputs, 1, axis=0)
    return (
        np.concatenate([before, inputs], axis=1), targets, counted.reshape(n, STEP), first,
        np.repeat(np.arange(len(texts)), chunks),
    )


def _softmax(logits: np.ndarray) -> np.ndarray:
    np.clip(logits, LEAST, MOST, out=logits)
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[-1], logits.dtype))[..., None]
    return logits


def _attention(query: np.ndarray, key: np.ndarray, distance: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights [n, STEP, WINDOW] of the keys up to each query, and their sums; a first window has none before its text."""
    weight = query @ key.transpose(0, 2, 1)
    weight += np.where(BACK < 0, FAR, distance[np.maximum(BACK, 0)]).astype(weight.dtype)
    weight[first, :, :STEP] = FAR
    np.minimum(weight, MOST, out=weight)
    np.exp(weight, out=weight)
    return weight, (weight @ np.ones(WINDOW, weight.dtype))[..., None]


def _log_chance(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log chance of the chosen column of each row; the logits are used up."""
    np.clip(logits, LEAST, MOST, out=logits)
    wanted = logits[np.arange(len(chosen)), chosen]
    np.exp(logits, out=logits)
    return wanted - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def by_class(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class that occurs and the places where it does."""
    order = np.argsort(classes.astype(np.int16), kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=CLASSES))
    start = 0
    for c, end in enumerate(ends.tolist()):
        if end > start:
            yield c, order[start:end]
        start = end


class Scorer:
    """Log chances of texts; what depends on the id alone is worked out once per id."""

    def __init__(self, model: Model):
        p = parts(model.weights)
        self.model, self.p = model, p
        query = model.vectors @ p["query"] * np.float32(KEY**-0.5)
        own = model.vectors @ p["own"] + p["shift"]
        # Side by side, so that a token is looked up once.
        self.table = np.concatenate([query, model.vectors @ p["key"], model.vectors @ p["value"], own], axis=1)

    def hidden(self, inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The hidden layer at every query, one row each. Where a window goes on from the one before, as the windows
        of a text do, it takes over what was looked up for that."""
        here = np.take(self.table, inputs[:, STEP:], axis=0)
        before = np.empty((len(inputs), STEP, 2 * KEY), here.dtype)
        before[1:] = here[:-1, :, KEY : 3 * KEY]
        before[0] = self.table[inputs[0, :STEP], KEY : 3 * KEY]
        both = np.concatenate([before, here[:, :, KEY : 3 * KEY]], axis=1)
        weight, whole = _attention(here[:, :, :KEY], both[:, :, :KEY], self.p["distance"], first)
        attended = weight @ both[:, :, KEY:]
        attended /= whole
        hidden = attended.reshape(-1, KEY) @ self.p["seen"]
        hidden += here[:, :, 3 * KEY :].reshape(-1, HIDDEN)
        return np.maximum(hidden, 0, out=hidden)

    def windows(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log chance of each target; windows of a text follow each other."""
        flat = targets.reshape(-1)
        classes, members = self.model.classes[flat], self.model.members[flat]
        out = self.model.share[flat]
        hidden = np.empty((len(flat), HIDDEN), out.dtype)
        for at in range(0, len(inputs), SCORE_WINDOWS):
            rows = slice(at * STEP, (at + SCORE_WINDOWS) * STEP)
            hidden[rows] = self.hidden(inputs[at : at + SCORE_WINDOWS], first[at : at + SCORE_WINDOWS])
            out[rows] += _log_chance(hidden[rows] @ self.p["out"] + self.p["prior"], classes[rows])
        for c, mine in by_class(classes):
            out[mine] += _log_chance(hidden[mine] @ self.p["inner"][c] + self.p["inner_prior"][c], members[mine])
        return out.reshape(targets.shape)

    def texts(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 chance of each text."""
        inputs, targets, counted, first, text = windows(texts, self.model.end)
        sums = np.zeros(len(first))
        for at in range(0, len(first), MEMBER_WINDOWS):
            to = slice(at, at + MEMBER_WINDOWS)
            sums[to] = (self.windows(inputs[to], targets[to], first[to]) * counted[to]).sum(1, dtype=np.float64)
        return np.bincount(text, sums, len(texts)) / np.log(10)


def gradient(model: Model, weights: np.ndarray, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log chance of the targets' classes and members, and its gradient in the weights."""
    p = parts(weights)
    out = np.zeros_like(weights)
    g = parts(out)
    n = len(inputs)
    scale = np.float32(KEY**-0.5)
    vectors = model.vectors[inputs]
    asking = vectors[:, STEP:]
    query, key, value = asking @ p["query"], vectors @ p["key"], vectors @ p["value"]
    query *= scale
    weight, whole = _attention(query, key, p["distance"], first)
    weight /= whole
    seen = weight @ value
    hidden = asking @ p["own"] + seen @ p["seen"] + p["shift"]
    active = np.maximum(hidden, 0)
    chance = _softmax(active @ p["out"] + p["prior"])

    wanted = model.classes[targets]
    at = np.arange(n)[:, None], np.arange(STEP)[None, :], wanted
    total = max(float(counted.sum()), 1.0)
    loss = -float((np.log(chance[at] + 1e-30) * counted).sum()) / total
    chance[at] -= 1
    chance *= counted[:, :, None] / np.float32(total)

    def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.reshape(-1, a.shape[-1]).T @ b.reshape(-1, b.shape[-1])

    g["out"][:] = product(active, chance)
    g["prior"][:] = chance.sum((0, 1))
    d_active = chance @ p["out"].T
    flat_active, flat_d, flat_counted = active.reshape(-1, HIDDEN), d_active.reshape(-1, HIDDEN), counted.reshape(-1)
    members = model.members[targets].reshape(-1)
    for c, mine in by_class(wanted.reshape(-1)):
        rows = flat_active[mine]
        inside = _softmax(rows @ p["inner"][c] + p["inner_prior"][c])
        there = np.arange(len(mine)), members[mine]
        loss -= float((np.log(inside[there] + 1e-30) * flat_counted[mine]).sum()) / total
        inside[there] -= 1
        inside *= flat_counted[mine][:, None] / np.float32(total)
        g["inner"][c] = rows.T @ inside
        g["inner_prior"][c] = inside.sum(0)
        flat_d[mine] += inside @ p["inner"][c].T
    d_hidden = d_active * (hidden > 0)
    g["own"][:] = product(asking, d_hidden)
    g["seen"][:] = product(seen, d_hidden)
    g["shift"][:] = d_hidden.sum((0, 1))
    d_seen = d_hidden @ p["seen"].T
    d_weight = d_seen @ value.transpose(0, 2, 1)
    d_scores = weight * (d_weight - (d_weight * weight).sum(-1, keepdims=True))
    g["value"][:] = product(vectors, weight.transpose(0, 2, 1) @ d_seen)
    g["distance"][:] = np.bincount(np.maximum(BACK, 0).ravel(), d_scores.sum(0).ravel(), WINDOW)
    g["query"][:] = product(asking, d_scores @ key) * scale
    g["key"][:] = product(vectors, d_scores.transpose(0, 2, 1) @ query)
    return loss, out


class Adam:
    """One run of the optimiser over a copy of the weights."""

    def __init__(self, weights: np.ndarray, rate: float = RATE):
        self.weights, self.rate, self.n = weights.astype(np.float32).copy(), rate, 0
        self.mean, self.square = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def step(self, gradient: np.ndarray) -> None:
        self.n += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.001 * (gradient * gradient - self.square)
        mean, square = self.mean / (1 - 0.9**self.n), self.square / (1 - 0.999**self.n)
        self.weights -= self.rate * mean / (np.sqrt(square) + 1e-8)


def token_vectors(after: np.ndarray, before: np.ndarray, width: int = VECTOR) -> np.ndarray:
    """Vectors of ids from counts of what stands after and before them: the main axes of their square-root shares."""
    n = before.sum(1)
    known = n > 0
    shares = np.sqrt(np.concatenate([after / np.maximum(after.sum(1), 1)[:, None], before / np.maximum(n, 1)[:, None]], 1))
    heavy = np.sqrt(n)[:, None]
    mean = (shares * heavy).sum(0) / max(heavy.sum(), 1e-9)
    centred = np.where(known[:, None], shares - mean, 0)
    _, axes = np.linalg.eigh((centred * heavy).T @ centred)
    made = centred @ axes[:, ::-1][:, :width]
    spread = np.sqrt((made**2 * heavy).sum(0) / max(heavy.sum(), 1e-9))
    return (made / np.maximum(spread, 1e-9)).astype(np.float32)


def token_classes(n: np.ndarray, before: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The class of each id: ids that stand after the same ids are clustered, from the most frequent ones as
    first centres; ids never seen are dealt to the classes in turn."""
    order = np.lexsort((np.arange(len(n)), -n))
    out = np.arange(len(n)) % CLASSES
    seen = order[n[order] > 0]
    if len(seen) < CLASSES:
        return out
    shares = np.sqrt(before[seen] / np.maximum(before[seen].sum(1), 1)[:, None]).astype(np.float32)
    centres = shares[:CLASSES].copy()
    heavy = np.sqrt(n[seen])
    for _ in range(rounds):
        near = (shares @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        for c in range(CLASSES):
            mine = near == c
            if mine.any():
                centres[c] = np.average(shares[mine], axis=0, weights=heavy[mine])
    out[seen] = near
    return out


def token_members(n: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Member of each id in its class and log share in that member, and log shares of classes and members.

    One is added to the count of each id.
    """
    counts = n + 1.0
    order = np.lexsort((np.arange(len(n)), -n, classes))
    starts = np.concatenate([[0], np.cumsum(np.bincount(classes, minlength=CLASSES))])
    members = np.empty(len(n), np.int64)
    members[order] = np.minimum(np.arange(len(n)) - starts[classes[order]], MEMBERS - 1)
    slot = classes * MEMBERS + members
    inside = np.bincount(slot, counts, CLASSES * MEMBERS)
    whole = np.bincount(classes, counts, CLASSES)
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = np.where(whole > 0, np.log(whole / whole.sum()), -30.0)
        inner = np.where(inside > 0, np.log(inside / np.repeat(whole, MEMBERS)), -30.0)
    share = np.log(counts / inside[slot]).astype(np.float32)
    return members, share, prior.astype(np.float32), inner.reshape(CLASSES, MEMBERS).astype(np.float32)
