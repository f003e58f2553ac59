"""Groups of 64-bit fingerprints at a small Hamming distance, found with a vantage-point tree.

A node picks a vantage point and measures every fingerprint's distance to it. Two fingerprints within
``radius`` of each other differ by at most ``radius`` in that distance (triangle bound). So

* everything within ``radius`` of the vantage point is one group with it. Those members need no comparison
  with each other, only with fingerprints at most ``2 * radius`` away from the vantage point. A crowd of near
  copies therefore costs one sweep, not all its pairs;
* the rest is split at the median distance. Both halves go on alone, and across the boundary only the bands
  within ``radius`` of it are compared.

Result is one edge from each member to its group's smallest fingerprint, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np

LEAF = 192
#: Comparisons held in memory at once.
BLOCK = 1 << 20


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


class Groups:
    """Groups over positions 0..n-1; edges are folded into labels before they can pile up."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._left: list[np.ndarray] = []
        self._right: list[np.ndarray] = []
        self._held = 0

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        if len(left):
            self._left.append(left)
            self._right.append(right)
            self._held += len(left)
            if self._held > 4 * len(self.label) + BLOCK:
                self.fold()

    def fold(self) -> np.ndarray:
        """Labels as the smallest position of each group."""
        if self._left:
            a, b = np.concatenate(self._left), np.concatenate(self._right)
            label = self.label
            while True:
                low = np.minimum(label[a], label[b])
                new = label.copy()
                np.minimum.at(new, label[a], low)
                np.minimum.at(new, label[b], low)
                while True:
                    jumped = new[new]
                    if np.array_equal(jumped, new):
                        break
                    new = jumped
                if np.array_equal(new, label):
                    break
                label = new
            self.label, self._left, self._right, self._held = label, [], [], 0
        return self.label


def _across(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, groups: Groups) -> None:
    step = max(1, BLOCK // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        i, j = np.nonzero(distance(fps[part][:, None], fps[right][None, :]) <= radius)
        groups.join(part[i], right[j])


def _touching(fps, ball: np.ndarray, ring: np.ndarray, radius: int, groups: Groups) -> None:
    """Ring members with any neighbour in the ball; the ball is one group already, so one link is enough."""
    step = max(1, BLOCK // max(1, len(ball)))
    for at in range(0, len(ring), step):
        part = ring[at : at + step]
        near = (distance(fps[part][:, None], fps[ball][None, :]) <= radius).any(axis=1)
        groups.join(part[near], np.full(int(near.sum()), ball[0]))


def groups_within(fps: np.ndarray, radius: int) -> np.ndarray:
    """Label of each of the distinct fingerprints: position of its group's first member."""
    groups = Groups(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        while len(at) > LEAF:
            d = distance(fps[at], fps[at[0]])
            inside = d <= radius
            ball, rest, d_rest = at[inside], at[~inside], d[~inside]
            groups.join(ball[1:], np.full(len(ball) - 1, ball[0]))
            _touching(fps, ball, rest[d_rest <= 2 * radius], radius, groups)
            if len(rest) <= LEAF or d_rest.min() == d_rest.max():
                at = rest
                continue
            middle = min(int(np.median(d_rest)), int(d_rest.max()) - 1)
            low = d_rest <= middle
            _across(
                fps, rest[low & (d_rest > middle - radius)], rest[~low & (d_rest <= middle + radius)],
                radius, groups,
            )
            todo.append(rest[~low])
            at = rest[low]
        if len(at) > 1:
            i, j = np.nonzero(np.triu(distance(fps[at][:, None], fps[at][None, :]) <= radius, 1))
            groups.join(at[i], at[j])
    return groups.fold()


def linked(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, group's smallest fingerprint) within ``left``, or between ``left`` and ``right``."""
    if right is None:
        fps = np.sort(left)
        label = groups_within(fps, radius)
    else:
        fps = np.concatenate([left, right])
        groups = Groups(len(fps))
        _across(fps, np.arange(len(left)), np.arange(len(left), len(fps)), radius, groups)
        label = groups.fold()
    moved = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[moved], fps[label[moved]]
