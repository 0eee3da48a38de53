"""Links among sets in memory: pivots, Voronoi regions and triangle windows, recursively."""

from __future__ import annotations

import numpy as np


def has_partner(n: np.ndarray, slack: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have another one they may link with.

    x and y can link only if slack(x) >= percent * n(y) and the other way
    round, where slack = (100 + percent) * shared - percent * n and shared is
    the part of a set that others hold too.
    """
    order = np.argsort(n, kind="stable")
    m, s = percent * n[order], slack[order]
    best = np.maximum.accumulate(s)
    # The second largest slack so far, so that no set is its own partner.
    second = np.full(len(s), np.iinfo(np.int64).min)
    if len(s) > 1:
        second[1:] = np.maximum.accumulate(np.minimum(s[1:], best[:-1]))
    last = np.searchsorted(m, s, side="right") - 1  # partners are at most this large
    rank = np.arange(len(s))
    at = np.maximum(last, 0)
    mine = (rank <= last) & (s >= best[at])
    ok = (last >= 0) & (np.where(mine, second[at], best[at]) >= m)
    out = np.zeros(len(n), bool)
    out[order] = ok
    return out


class JaccardSpace:
    """Sets of hashes as an inverted list: distances of one set to all others."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.keys, item = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.holders = owner[np.argsort(item, kind="stable")]
        self.df = np.bincount(item, minlength=len(self.keys))
        self.first = np.cumsum(self.df) - self.df
        self.item = item
        self.start = np.cumsum(self.n) - self.n
        self.own = np.bincount(owner, self.df[item] == 1, len(sets)).astype(np.int64)

    def _common(self, items: np.ndarray) -> np.ndarray:
        length = self.df[items]
        at = np.arange(length.sum()) + np.repeat(self.first[items] - (np.cumsum(length) - length), length)
        return np.bincount(self.holders[at], minlength=len(self.n))

    def common(self, i: int) -> np.ndarray:
        """Intersection sizes of set i with all sets; shingles of its own are skipped."""
        items = self.item[self.start[i] : self.start[i] + self.n[i]]
        found = self._common(items[self.df[items] > 1])
        found[i] = self.n[i]
        return found

    def distances_from(self, s: np.ndarray) -> np.ndarray:
        """Jaccard distances of any set to all sets of the space."""
        if not len(self.keys):
            return np.ones(len(self.n))
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        c = self._common(at[self.keys[at] == s])
        return 1 - c / np.maximum(self.n + len(s) - c, 1)

    def slack(self, percent: int) -> np.ndarray:
        return (100 + percent) * (self.n - self.own) - percent * self.n


def settle(sets: list[np.ndarray], known: np.ndarray, owns: np.ndarray, percent: int, leaf: int, pivots: int) -> np.ndarray:
    """Component numbers: ``known`` ones joined by all links that have an end in ``owns``."""
    label = known.copy()
    _region(sets, np.arange(len(sets)), owns.astype(bool), label, percent, leaf, pivots)
    return label


def _join(label: np.ndarray, nodes: np.ndarray) -> None:
    found = np.unique(label[nodes])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


def _region(sets, nodes, owns, label, percent, leaf, pivots) -> None:
    """Settle the region of ``nodes``, those with ``owns`` being its own and the others guests."""
    if not _open(label[nodes], owns):
        return
    while True:  # sets without a possible partner leave, and what only they shared with others becomes these others' own
        space = JaccardSpace(sets)
        live = has_partner(space.n, space.slack(percent), percent)
        if live.all():
            break
        sets, nodes, owns = [s for s, x in zip(sets, live) if x], nodes[live], owns[live]
        if not _open(label[nodes], owns):
            return
    if _outside(label[nodes]) <= leaf:
        return _compare(space, nodes, owns, label, percent)
    r, near = 1 - percent / 100, 1e-9
    d, closest, at = [], np.full(len(nodes), np.inf), int(np.argmin(space.own / space.n))
    while len(d) < pivots:
        c = space.common(at)
        links = 100 * c >= percent * (space.n + space.n[at] - c)
        _join(label, nodes[links])
        d.append(1 - c / (space.n + space.n[at] - c))
        closest = np.minimum(closest, d[-1])
        at = int(np.argmax(closest))  # the next pivot is the node furthest from all
        if closest[at] <= r:
            break
    d = np.array(d)
    nearest = d.argmin(axis=0)
    parts, work = [], 0
    for j in range(len(d)):
        mine = nearest == j
        at = np.flatnonzero(mine | (d[j] <= closest + 2 * r + near))
        if _open(label[nodes[at]], (owns & mine)[at]):
            parts.append((at, (owns & mine)[at]))
            work += _outside(label[nodes[at]]) * len(at)
    if work > 0.7 * _outside(label[nodes]) * len(nodes):  # windows as wide as the region: splitting would only repeat work
        return _compare(space, nodes, owns, label, percent)
    for at, own in parts:
        _region([sets[i] for i in at], nodes[at], own, label, percent, leaf, pivots)


def _outside(label: np.ndarray) -> int:
    """How many nodes lie outside the largest component."""
    return len(label) - int(np.unique(label, return_counts=True)[1].max())


def _open(label: np.ndarray, owns: np.ndarray) -> bool:
    """Whether pairs of two components are left that an own node is part of."""
    return len(label) > 1 and owns.any() and bool((label != label[0]).any())


def _compare(space, nodes, owns, label, percent) -> None:
    """All pairs of two components that an own node is part of.

    Pairs within the largest component are settled, so only nodes outside
    it are taken one by one and compared with the whole region.
    """
    slack = space.slack(percent)
    found, size = np.unique(label[nodes], return_counts=True)
    outside = label[nodes] != found[size.argmax()]
    for i in np.flatnonzero(outside):
        may = (label[nodes] != label[nodes[i]]) & (slack[i] >= percent * space.n) & (slack >= percent * space.n[i])
        if not owns[i]:
            may &= owns
        if may.any():
            c = space.common(i)
            links = may & (100 * c >= percent * (space.n + space.n[i] - c))
            if links.any():
                _join(label, np.append(nodes[links], nodes[i]))
