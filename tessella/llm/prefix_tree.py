"""A prefix tree of globally ordered sets, and links between sets by traversing it.

All sets of a tree follow one order, from the elements that few of them hold to those that many hold, so
sets with a common start share a path, and sets that are apart differ early.  A traversing set goes
down all paths at once, level by level; the overlap so far is counted once for all sets below a path.
A subtree is left as soon as that overlap and what can still follow on both sides fall short of what the
least demanding size below needs.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tessella.llm.measure import Measure

#: Elements of one node at most; a longer path is a chain of nodes, so that it can be left midway.
SEGMENT = 32


def _ranked(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets with ranks for elements, ascending: those in few sets first, ties by value."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(values), dtype=np.int32)
    ranks = rank[at]
    ranks = ranks[np.lexsort((ranks, owner))]
    return np.split(ranks, np.cumsum([len(s) for s in sets])[:-1])


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], .. count[0] numbers, then first[1], ..."""
    return np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())


class PrefixTree:
    """Sets (distinct, not empty, ascending hashes) by their numbers."""

    def __init__(self, sets: list[np.ndarray], measure: Measure):
        self.measure = measure
        self.sets = _ranked(sets)
        self.inside = np.zeros(int(max(s[-1] for s in self.sets)) + 1, bool)
        paths = [s.astype(">i4").tobytes() for s in self.sets]
        self.order = np.array(sorted(range(len(paths)), key=paths.__getitem__))  # with common starts next to each other
        self._lay_out(self._forks([self.sets[k] for k in self.order]))

    @staticmethod
    def _forks(paths: list[np.ndarray]) -> list:
        """The root [depth, low, high, children]: below a node are the paths from low up to high; they share their starts up to depth."""
        open_ = [[0, 0, 0, []]]
        for k in range(len(paths) + 1):
            shared = 0
            if 0 < k < len(paths):
                n = min(len(paths[k - 1]), len(paths[k]))
                apart = np.nonzero(paths[k - 1][:n] != paths[k][:n])[0]
                shared = int(apart[0]) if len(apart) else n
            while open_[-1][0] > shared:
                node = open_.pop()
                node[2] = k
                if open_[-1][0] < shared:
                    open_.append([shared, node[1], 0, []])
                open_[-1][3].append(node)
            if k < len(paths):
                open_.append([len(paths[k]), k, 0, []])
        root = open_[0]
        root[2] = len(paths)
        return root

    def _lay_out(self, root: list) -> None:
        """Nodes as arrays, numbered level by level, so that the children of a node are a range."""
        starts = np.append(0, np.cumsum([len(self.sets[k]) for k in self.order]))
        self.flat = np.concatenate([self.sets[k] for k in self.order])
        sizes = np.diff(starts)
        rows, level, following = [], [(root, 0)], 1
        while level:
            below = []
            for node, begin in level:
                depth, low, high, children = node
                end = min(depth, begin + SEGMENT)
                lower = [(node, end)] if end < depth else [(x, depth) for x in children]
                rows.append((starts[low] + begin, end - begin, end, low, high, following, len(lower)))
                following += len(lower)
                below += lower
            level = below
        self.start, self.length, self.depth, self.low, self.high, self.child, self.children = np.array(rows, np.int64).T
        bounds = np.stack([self.low, self.high], 1).ravel()
        self.least = np.minimum.reduceat(np.append(sizes, 0), bounds)[::2]  # of the sizes below
        self.most = np.maximum.reduceat(np.append(sizes, 0), bounds)[::2]
        self.ends = sizes[self.low] == self.depth  # the first path below ends here

    def linked(self, k: int, group: np.ndarray) -> np.ndarray:
        """Numbers of the sets that are linked with set k and whose group isn't its own."""
        found, size, need = self.sets[k], len(self.sets[k]), self.measure.need
        sorted_ = group[self.order]
        changes = np.append(0, np.cumsum(sorted_[1:] != sorted_[:-1]))
        self.inside[found] = True
        at, overlap, out = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(at):
            nodes = _spread(self.child[at], self.children[at])
            overlap = np.repeat(overlap, self.children[at])
            low, high = self.low[nodes], self.high[nodes] - 1
            other = (changes[low] != changes[high]) | (sorted_[low] != group[k])
            nodes, overlap = nodes[other], overlap[other]
            if not len(nodes):
                break
            length = self.length[nodes]
            hits = self.inside[self.flat[_spread(self.start[nodes], length)]]
            overlap = overlap + np.add.reduceat(hits, np.append(0, np.cumsum(length)[:-1]), dtype=np.int64)
            left = size - np.searchsorted(found, self.flat[self.start[nodes] + length - 1], "right")  # what can follow in this set
            depth, least, most = self.depth[nodes], self.least[nodes], self.most[nodes]
            best = np.minimum(np.maximum(least, depth + left), most)  # of the sizes below, the one that asks least for what it can still give
            full = self.ends[nodes] & (overlap >= need(size, depth))
            out.append(self.order[self.low[nodes[full]]])
            alive = overlap + np.minimum(left, best - depth) >= need(size, best)
            at, overlap = nodes[alive], overlap[alive]
        self.inside[found] = False
        out = np.concatenate(out) if out else np.zeros(0, np.int64)
        return out[group[out] != group[k]]


def spanning_links(sets: list[np.ndarray], measure: Measure, group: Iterable[int], known: int | None, probes: Iterable[int]) -> list[tuple[int, int]]:
    """Links between sets of different groups, as many as are needed to join all groups that links connect.

    The probes traverse the tree in turn, but for those in the group of the set `known` by then (if it is a probe, it comes first).
    Links are lost if neither end is a probe, unless both are in that group."""
    tree, group, out = PrefixTree(sets, measure), np.array(group, np.int64), []
    for k in probes:
        if known is not None and k != known and group[k] == group[known]:
            continue
        for j in tree.linked(k, group).tolist():
            if group[j] != group[k]:
                out.append((k, j))
                group[group == group[j]] = group[k]
    return out
