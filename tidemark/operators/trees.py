"""Boosted trees and a random forest over blocks of sparse rows, grown level by level.

Trees lie in arrays: the children of node i are 2i + 1 and 2i + 2; a node without a split
sends all rows to the left, where its value is repeated. Only slots above zero are summed:
what lies to the right of a threshold is a sum over slots, what lies to the left is the rest.
Sums are whole numbers, so trees do not depend on how rows are dealt over blocks and tasks
(a forest's draws of rows do).

Boosting minimises log loss with labels of -1 and 1: the first tree fits the labels, each
further one, times a rate, the loss's gradient; values are means. A level is one pass, for one
child of each pair, since the other one has the rest. A forest's trees grow at once: each has
rows drawn with replacement (by Poisson numbers), each node draws its features, splits have
the best Gini gain, and siblings that vote alike are put together.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np

from .blocks import SLOTS, Block, Passes, Slots

#: Bytes of margins that a worker keeps from pass to pass; it can make them again from the trees.
KEPT = 1 << 26
#: Nodes of a forest whose sums are taken in one pass, nodes that are split at a time, and rows of a step over them.
NODES, SPLIT, STEP = 512, 64, 256
#: Parts of one in which gradients are counted, and where the number of rows begins in a sum; gradients lie within 4.
UNIT, COUNT = 1 << 27, 46
#: Where the number of rows with label 1 begins, in a block's sums and in all.
ONES, ALL_ONES = 20, 32
#: Gains that are no more than rounding.
LEAST_GAIN = 1e-12


@dataclass
class Trees:
    """Full trees: feature and threshold of each inner node, and the values of all nodes. A row goes right if its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each row of x and each tree the value that the row ends with."""
        trees, width = self.feature.shape
        tree, node = np.arange(trees) * width, np.zeros((len(x), trees), np.int64)
        row, flat = np.arange(len(x))[:, None] * x.shape[1], x.ravel()
        for _ in range((width + 1).bit_length() - 1):
            at = tree + node
            node = 2 * node + 1 + (flat.take(row + self.feature.take(at)) > self.threshold.take(at))
        return self.value.take(np.arange(trees) * self.value.shape[1] + node)


def full(split: np.ndarray, value: np.ndarray, slots: Slots) -> Trees:
    """Trees from the slots at which nodes split (-1: none) and the nodes' values, which are repeated below leaves."""
    value, none = value.copy(), split < 0
    for i in range(split.shape[1]):
        value[:, 2 * i + 1] = np.where(none[:, i], value[:, i], value[:, 2 * i + 1])
    feature, cuts = (np.append(x, 0)[np.where(none, -1, split)] for x in (slots.feature, slots.cuts))
    return Trees(feature, np.where(none, np.inf, cuts), value)


@dataclass
class Boosted:
    trees: Trees
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.trees.leaves(x) @ self.weights))


@dataclass
class Forest:
    trees: Trees

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.trees.leaves(x).mean(1)


_margins: OrderedDict[tuple, tuple[int, np.ndarray]] = OrderedDict()
_held = np.zeros((3, 1), np.int64)


def held(n: int) -> np.ndarray:
    """Three rows of n numbers whose memory is used again by each block; the first number of the last is 0."""
    global _held
    if _held.shape[1] < n:
        _held = np.zeros((3, n), np.int64)
    return _held[:, :n]


def routed(b: Block, split: np.ndarray, ends: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after so many levels of a tree."""
    node = np.zeros(len(b.y), np.int64)
    for level in range(levels):
        right = np.zeros(len(b.y), np.int64)
        for i in range(2**level - 1, 2 ** (level + 1) - 1):
            if split[i] >= 0:
                rows = b.rows[b.starts[split[i]] : b.starts[ends[i]]]
                right[rows[node[rows] == i]] = 1
        node = 2 * node + 1 + right
    return node


@dataclass
class Gradients:
    """For each of the nodes asked for: rows and sums of gradients, of each slot and then of all rows."""

    fit: str
    depth: int
    rate: float
    #: Of each tree and, last, the one that grows: splits, their features' last slots, values.
    split: np.ndarray
    ends: np.ndarray
    value: np.ndarray
    level: int
    nodes: list[int]

    def margin(self, b: Block) -> np.ndarray:
        key, last = (self.fit, b.id, len(b.y)), len(self.split) - 1
        done, margin = _margins.pop(key, (0, np.zeros(len(b.y))))
        if done > last:
            done, margin = 0, np.zeros(len(b.y))
        for t in range(done, last):
            margin = margin + (self.rate if t else 1.0) * self.value[t][routed(b, self.split[t], self.ends[t], self.depth)]
        _margins[key] = (last, margin)
        while sum(m.nbytes for _, m in _margins.values()) > KEPT:
            _margins.popitem(last=False)
        return margin

    def __call__(self, b: Block) -> np.ndarray:
        y = 2.0 * b.y - 1
        gradient = 4 * y / (1 + np.exp(2 * y * self.margin(b))) if len(self.split) > 1 else y
        z = (1 << COUNT) + np.rint((gradient + 4) * UNIT).astype(np.int64)
        node, (rows, each, upto) = routed(b, self.split[-1], self.ends[-1], self.level), held(len(b.rows) + 1)
        rows[1:] = b.rows
        out = np.empty((len(self.nodes), 2, len(b.starts)), np.int64)
        for k, i in enumerate(self.nodes):
            own = np.where(node == i, z, 0)
            own.take(rows[1:], out=each[1:], mode="clip")
            np.cumsum(each[1:], out=upto[1:])
            sums = np.append(np.diff(upto.take(b.starts)), own.sum())  # right even where the running sum wraps around
            out[k, 0] = sums >> COUNT
            out[k, 1] = (sums & ((1 << COUNT) - 1)) - 4 * UNIT * out[k, 0]
        return out.ravel()


@dataclass
class Boosting:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    fit: str = field(default_factory=lambda: uuid.uuid4().hex)

    def best(self, sums: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
        """(slot, sums of the left side, of the right side) of the split with the largest gain of variance, the first of equals."""
        every = sums[:, -1]
        upto = np.concatenate([np.zeros((2, 1), np.int64), sums[:, :-1].cumsum(1)], 1)
        right = upto[:, ends] - upto[:, :-1]
        left = every[:, None] - right
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ((left[1] / UNIT) ** 2 / left[0] + (right[1] / UNIT) ** 2 / right[0] - (every[1] / UNIT) ** 2 / every[0]) / every[0]
        gain = np.where((left[0] > 0) & (right[0] > 0), gain, -1.0)
        at = int(gain.argmax()) if len(gain) else -1
        return None if at < 0 or gain[at] <= LEAST_GAIN else (at, left[:, at], right[:, at])

    def __call__(self, passes: Passes, slots: Slots) -> Boosted:
        inner, ends = 2**self.depth - 1, slots.ends
        split, last, value = np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, 2 * inner + 1))
        mean = lambda s: s[1] / UNIT / s[0]
        for _ in range(self.rounds):
            split, last, value = (np.concatenate([x, np.full((1, x.shape[1]), empty)]) for x, empty in ((split, -1), (last, -1), (value, 0.0)))
            found: dict[int, np.ndarray] = {}
            asked = {0: None}  # of pairs of siblings the one that is asked for, and the other
            for level in range(self.depth):
                if not asked:
                    break
                each = passes(Gradients(self.fit, self.depth, self.rate, split, last, value, level, list(asked))).reshape(len(asked), 2, -1)
                for (i, other), sums in zip(asked.items(), each, strict=True):
                    found[i] = sums
                    if other is not None:
                        found[other] = found[(i - 1) // 2] - sums
                if not level:
                    value[-1][0] = mean(found[0][:, -1])
                asked = {}
                for i in range(2**level - 1, 2 ** (level + 1) - 1):
                    best = self.best(found[i], ends) if i in found else None
                    if best:
                        at, left, right = best
                        split[-1][i], last[-1][i] = at, ends[at]
                        value[-1][2 * i + 1], value[-1][2 * i + 2] = mean(left), mean(right)
                        less = 2 * i + 1 + int(right[0] < left[0])
                        asked[less] = 4 * i + 3 - less
            for i in range(inner):  # rows of a leaf go on to the left
                if split[-1][i] < 0:
                    value[-1][2 * i + 1] = value[-1][i]
        weights = np.full(self.rounds, self.rate)
        weights[:1] = 1.0
        return Boosted(full(split, value, slots), weights)


@dataclass
class Counts:
    """For nodes of a forest: drawn rows, and those with label 1, of each slot of each drawn feature, then of all rows."""

    seed: int
    level: int
    base: np.ndarray
    #: Of the trees asked for: their numbers, each node's feature and least slot of the right side (255: none), and the place of each node of the level (-1: not asked for).
    trees: np.ndarray
    feature: np.ndarray
    least: np.ndarray
    place: np.ndarray
    drawn: np.ndarray

    def __call__(self, b: Block) -> np.ndarray:
        n, width, (nodes, m) = len(b.y), len(self.base) - 1, self.drawn.shape
        slot = np.concatenate([np.arange(1, k + 1, dtype=np.uint8) for k in np.diff(self.base)] or [np.zeros(0, np.uint8)])
        x = np.zeros((n, max(1, width)), np.uint8)
        x[b.rows, np.repeat(np.arange(width), np.diff(b.starts[self.base]))] = np.repeat(slot, np.diff(b.starts))
        weight = np.stack([np.random.default_rng([self.seed, t, b.id]).poisson(1.0, n) for t in self.trees.tolist()], 1)
        unit = weight * (1 + (b.y[:, None].astype(np.int64) << ONES))
        tree, size = np.arange(len(self.trees)), self.feature.shape[1]
        keys, units = [], []
        every = np.zeros(nodes)
        for at in range(0, n, STEP):
            part, flat = x[at : at + STEP], x[at : at + STEP].ravel()
            row, node = np.arange(len(part))[:, None] * x.shape[1], np.zeros((len(part), len(tree)), np.int64)
            for _ in range(self.level):
                own = tree * size + node
                node = 2 * node + 1 + (flat.take(row + self.feature.take(own)) >= self.least.take(own))
            own = self.place.take(tree * 2**self.level + node - (2**self.level - 1))
            some = np.flatnonzero((own >= 0) & (weight[at : at + STEP] > 0))
            own, w = own.ravel()[some], unit[at : at + STEP].ravel()[some]
            every += np.bincount(own, w, nodes)
            got = flat.take((some // len(tree) * x.shape[1])[:, None] + self.drawn[own]).ravel()
            hit = np.flatnonzero(got)
            keys.append((own[hit // m] * m + hit % m) * SLOTS + got[hit] - 1)
            units.append(w[hit // m])
        sums = np.concatenate([np.bincount(np.concatenate(keys), np.concatenate(units), nodes * m * SLOTS), every]).astype(np.int64)
        return (sums & ((1 << ONES) - 1)) | (sums >> ONES) << ALL_ONES


@dataclass
class Growing:
    #: Values that one task fits by itself: fewer than elsewhere, since passes are few and long.
    here: ClassVar[int] = 1 << 22
    count: int = 100
    depth: int = 10
    seed: int = 42

    def __call__(self, passes: Passes, slots: Slots) -> Forest:
        width, inner = len(slots.base) - 1, 2**self.depth - 1
        m = int(np.ceil(np.sqrt(width)))
        split, n, ones = np.full((self.count, inner), -1), np.zeros((self.count, 2 * inner + 1), np.int64), np.zeros((self.count, 2 * inner + 1), np.int64)
        open_ = [(t, 0) for t in range(self.count)]
        for level in range(self.depth):
            grown = []
            for g, first in enumerate(range(0, len(open_), NODES)):
                some = np.array(open_[first : first + NODES])
                rng = np.random.default_rng([self.seed, level, g])
                drawn = np.sort(rng.random((len(some), width)).argpartition(m - 1, 1)[:, :m], 1) if m else np.zeros((len(some), 0), np.int64)
                trees = np.unique(some[:, 0])
                mine, none = split[trees], split[trees] < 0
                feature, least = (np.where(none, empty, np.append(x, 0)[mine]) for x, empty in ((slots.feature, 0), (np.arange(len(slots.cuts)) - slots.base[slots.feature] + 1, 255)))
                place = np.full((len(trees), 2**level), -1)
                place[np.searchsorted(trees, some[:, 0]), some[:, 1] - (2**level - 1)] = np.arange(len(some))
                got = passes(Counts(self.seed, level, slots.base, trees, feature, least.astype(np.uint8), place, drawn))
                cells, every = got[: -len(some)].reshape(*drawn.shape, SLOTS), got[-len(some) :]
                for k in range(0, len(some), SPLIT):
                    own = slice(k, k + SPLIT)
                    grown += self.split(some[own], drawn[own], cells[own], every[own], slots, split, n, ones)
            open_ = sorted(grown)
        prune(split, n, ones)
        return Forest(full(split, np.where(n, ones / np.maximum(1, n), 0.5), slots))

    def split(self, some: np.ndarray, drawn: np.ndarray, cells: np.ndarray, every: np.ndarray, slots: Slots, split: np.ndarray, n: np.ndarray, ones: np.ndarray) -> list[tuple[int, int]]:
        """Splits the nodes by their best gains; the children that can be split further."""
        low = (1 << ALL_ONES) - 1
        tree, node = some.T
        all_, all_ones = every & low, every >> ALL_ONES
        n[tree, node], ones[tree, node] = all_, all_ones
        if not drawn.shape[1]:
            return []
        right = cells[:, :, ::-1].cumsum(2)[:, :, ::-1].reshape(len(some), -1)
        right, right_ones = right & low, right >> ALL_ONES
        left, left_ones = all_[:, None] - right, all_ones[:, None] - right_ones
        impure = lambda k, c: 2 * k * (c - k) / np.maximum(1, c)  # noqa: E731  Gini times rows
        gain = impure(all_ones, all_)[:, None] - impure(left_ones, left) - impure(right_ones, right)
        gain = np.where((left > 0) & (right > 0), gain / np.maximum(1, all_)[:, None], -1.0)
        at = gain.argmax(1)
        more = []
        for k in np.flatnonzero(gain[np.arange(len(some)), at] > LEAST_GAIN).tolist():
            t, i, a = int(tree[k]), int(node[k]), at[k]
            split[t, i] = slots.base[drawn[k, a // SLOTS]] + a % SLOTS
            for child, c, o in ((2 * i + 1, left[k, a], left_ones[k, a]), (2 * i + 2, right[k, a], right_ones[k, a])):
                n[t, child], ones[t, child] = c, o
                if 0 < o < c and child < split.shape[1]:
                    more.append((t, child))
        return more


def prune(split: np.ndarray, n: np.ndarray, ones: np.ndarray) -> None:
    """Leaves of one parent that vote alike become one leaf, from below upwards; a tie votes 0."""
    leaf, vote = np.ones(n.shape, bool), 2 * ones > n
    leaf[:, : split.shape[1]] = split < 0
    for i in range(split.shape[1] - 1, -1, -1):
        same = (split[:, i] >= 0) & leaf[:, 2 * i + 1] & leaf[:, 2 * i + 2] & (vote[:, 2 * i + 1] == vote[:, 2 * i + 2])
        split[same, i], leaf[same, i] = -1, True
