"""Hierarchical navigable small-world graphs of unit vectors: one shard is built and searched in NumPy, many queries abreast."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .common import mix64

#: Links a node at the upper levels (twice as many at the lowest), and how many candidates it chooses them from.
LINKS, BUILD_BEAM = 12, 40
#: Nodes that join a graph together, at most; they are no more than those already in it.
BATCH = 512
#: Nodes of a query's beam whose links one step follows.
ABREAST = 3
#: (query, node) marks that one step of a search may hold: queries go through a shard in groups of so many over its size.
MARKS = 4 << 20
#: How far under the wanted cosine a search still walks on.
SLACK = 0.05


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, without overflow."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def levels(node: np.ndarray) -> np.ndarray:
    """The highest level of each node, geometric, from a hash of its number."""
    u = ((mix64(node.astype(np.uint64) + np.uint64(0x51ED)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return np.floor(-np.log(u) / np.log(LINKS)).astype(np.int64)


class Graph:
    """Nodes stand in the order of their levels, highest first, so that a level's nodes are the first so many; links[k] has a row for each, padded with -1.

    entries: where a search of the lowest level begins besides its way down, so that every node can be reached.
    """

    def __init__(self, v: np.ndarray, links: list[np.ndarray], entries: np.ndarray):
        self.exact, self.links, self.entries = v, links, entries
        self.v = v.astype(np.float32)

    @cached_property
    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the lowest level, where each node's neighbours begin in a list of them: those that it links to and those that link to it."""
        n = len(self.v)
        a, c = np.nonzero(self.links[0] >= 0)
        b = self.links[0][a, c].astype(np.int64)
        key = np.unique(np.concatenate((a * n + b, b * n + a)))
        return np.searchsorted(key, np.arange(n + 1) * n), key % n

    # ---- search ----

    def descend(self, q: np.ndarray, low: int) -> np.ndarray:
        """For each query the node that a greedy walk from the top down to level low + 1 ends at."""
        at = np.zeros(len(q), dtype=np.int64)
        best = q @ self.v[0]
        for links in self.links[:low:-1]:
            live = np.arange(len(q))
            while len(live):
                near = links[at[live]]
                cosine = np.where(near >= 0, np.matmul(self.v[near], q[live, :, None])[:, :, 0], -np.inf)
                pick = cosine.argmax(axis=1)
                top = cosine[np.arange(len(live)), pick]
                better = top > best[live]
                at[live[better]], best[live[better]] = near[np.arange(len(live)), pick][better], top[better]
                live = live[better]
        return at

    def beam(self, q: np.ndarray, width: int, level: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the best width nodes found for each query (-1: none) and their cosines, best first. size: how many of the level's nodes are linked already."""
        links = self.links[level]
        n = len(links) if size is None else size
        starts = np.column_stack([self.descend(q, level), *(np.full(len(q), e) for e in (self.entries if level == 0 else []))])
        starts[starts >= n] = 0  # a node of the level above that isn't in this one yet
        seen = np.zeros((len(q), n + 1), dtype=bool)  # the last column is that of -1
        rows = np.arange(len(q))[:, None]
        fresh = np.ones(starts.shape, dtype=bool)
        for k in range(1, starts.shape[1]):
            fresh[:, k] = (starts[:, k : k + 1] != starts[:, :k]).all(axis=1)
        seen[rows, starts] = True
        cosine = np.where(fresh, np.matmul(self.v[starts], q[:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        ids = np.where(fresh, starts, -1)
        if (short := width - ids.shape[1]) > 0:
            ids = np.pad(ids, ((0, 0), (0, short)), constant_values=-1)
            cosine = np.pad(cosine, ((0, 0), (0, short)), constant_values=-np.inf)
        open_ = ids >= 0
        live = np.arange(len(q))
        while len(live):
            best = np.where(open_[live], cosine[live], -np.inf)
            pick = np.argpartition(-best, ABREAST - 1, axis=1)[:, :ABREAST] if width > ABREAST else np.arange(width)[None, :].repeat(len(live), axis=0)
            some = np.take_along_axis(best, pick, axis=1) > -np.inf
            on = some.any(axis=1)
            live, pick, some = live[on], pick[on], some[on]
            if not len(live):
                break
            near = links[np.where(some, ids[live[:, None], pick], 0)].astype(np.int64)
            near[~some] = -1
            open_[live[:, None], pick] = False
            at, new = live[:, None], np.zeros(near.shape, dtype=bool)
            for k in range(pick.shape[1]):  # one after the other, so that no node is new twice
                mine = near[:, k]
                new[:, k] = (mine >= 0) & ~seen[at, mine]
                seen[at, mine] |= new[:, k]
            near, new = near.reshape(len(live), -1), new.reshape(len(live), -1)
            r, c = np.nonzero(new)
            found = np.full(near.shape, -np.inf, dtype=np.float32)
            found[r, c] = np.einsum("ij,ij->i", self.v[near[r, c]], q[live[r]])
            cosine_, ids_, opened = np.concatenate((cosine[live], found), axis=1), np.concatenate((ids[live], np.where(new, near, -1)), axis=1), np.concatenate((open_[live], new), axis=1)
            top = np.argpartition(-cosine_, width - 1, axis=1)[:, :width]
            cosine[live], ids[live], open_[live] = (np.take_along_axis(x, top, axis=1) for x in (cosine_, ids_, opened))
        order = np.argsort(-cosine, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(cosine, order, axis=1)

    def within(self, exact: np.ndarray, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a cosine of at least so much, checked in double precision; exact: unit rows, so many that their marks fit.

        A beam finds where to begin. From what it has within SLACK of the bound, a walk goes over all neighbours that are as near, so that however many nodes are within
        the bound, none is left out for want of room.
        """
        q = exact.astype(np.float32)
        ids, found = self.beam(q, width)
        r, c = np.nonzero((found >= cosine - SLACK) & (ids >= 0))
        n = len(self.v)
        first, near = self.both_ways
        seen = np.zeros(len(q) * n, dtype=bool)
        key = r * n + ids[r, c]
        seen[key] = True
        pairs = [key]
        while len(key):
            low, many = first[key % n], np.diff(first)[key % n]
            step = np.repeat(key - key % n, many) + near[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            step = np.unique(step[~seen[step]])
            seen[step] = True
            key = step[self._cosines(self.v, q, step) >= cosine - SLACK]
            pairs.append(key)
        key = np.concatenate(pairs)
        key = key[self._cosines(self.exact, exact, key) >= cosine]
        return key // n, key % n

    def _cosines(self, v: np.ndarray, q: np.ndarray, key: np.ndarray) -> np.ndarray:
        n, found = len(v), np.empty(len(key), dtype=v.dtype)
        for low in range(0, len(key), 1 << 16):
            k = key[low : low + (1 << 16)]
            found[low : low + (1 << 16)] = np.einsum("ij,ij->i", q[k // n], v[k % n])
        return found


# ---- build ----


def _choose(v: np.ndarray, ids: np.ndarray, cosine: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (ids, -1: none; their cosines to the row's node, best first) most of them: first those that are nearer to the node than to any
    chosen before, so that links lead into all directions, then the nearest of the rest."""
    x = v[np.maximum(ids, 0)]
    between = np.matmul(x, x.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, dtype=bool)
    for j in range(ids.shape[1]):
        crowded = (kept[:, :j] & (between[:, j, :j] > cosine[:, j : j + 1])).any(axis=1)
        kept[:, j] = (ids[:, j] >= 0) & ~crowded & (kept.sum(axis=1) < most)
    order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
    chosen = np.take_along_axis(ids, order, axis=1)
    return np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1).astype(np.int32)


def _link_back(v: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """The nodes that new nodes link to get links back; where there are too many, they choose again."""
    to, nth = np.nonzero(links[new] >= 0)
    source, target = new[to], links[new][to, nth].astype(np.int64)
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    touched, first, many = np.unique(target, return_index=True, return_counts=True)
    for low in range(0, len(touched), 2 * BATCH):
        t, f, m = (x[low : low + 2 * BATCH] for x in (touched, first, many))
        added = np.full((len(t), m.max()), -1, dtype=np.int64)
        place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        added[np.repeat(np.arange(len(t)), m), place] = source[np.repeat(f, m) + place]
        ids = np.concatenate((links[t].astype(np.int64), added), axis=1)
        twice = (added[:, :, None] == links[t][:, None, :]).any(axis=2)
        ids[:, links.shape[1] :][twice] = -1
        cosine = np.where(ids >= 0, np.matmul(v[np.maximum(ids, 0)], v[t][:, :, None])[:, :, 0], -np.inf)
        best = np.argsort(-cosine, axis=1, kind="stable")[:, : links.shape[1] + BUILD_BEAM]
        links[t] = _choose(v, np.take_along_axis(ids, best, axis=1), np.take_along_axis(cosine, best, axis=1), links.shape[1])


def _reach(links: np.ndarray) -> np.ndarray:
    """Where searches must begin, besides node 0, to get everywhere."""
    reached, entries = np.zeros(len(links), dtype=bool), []
    start = 0
    while True:
        reached[start] = True
        front = np.array([start])
        while len(front):
            near = links[front].ravel()
            front = np.unique(near[near >= 0])
            front = front[~reached[front]]
            reached[front] = True
        if reached.all():
            return np.array(entries, dtype=np.int64)
        start = int(np.argmin(reached))
        entries.append(start)


def build(v: np.ndarray, top: np.ndarray) -> Graph:
    """A graph of unit rows v; top: the highest level of each, in falling order.

    Levels are built from the highest down. A batch of nodes is searched for in the graph so far, compared with each other too, and linked both ways.
    """
    high = int(top[0]) if len(top) else 0
    sizes = [int((top >= k).sum()) for k in range(high + 1)]
    graph = Graph(v, [np.full((m, LINKS * (1 if k else 2)), -1, dtype=np.int32) for k, m in enumerate(sizes)], np.zeros(0, dtype=np.int64))
    for level in range(high, -1, -1):
        links, done = graph.links[level], 0
        while done < sizes[level]:
            new = np.arange(done, min(sizes[level], done + min(BATCH, max(done, 64))))
            q = graph.v[new]
            among = q @ q.T
            np.fill_diagonal(among, -np.inf)
            near = np.argsort(-among, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, cosine = new[near], np.take_along_axis(among, near, axis=1)
            ids = np.where(np.isfinite(cosine), ids, -1)
            if done:
                old, far = graph.beam(q, BUILD_BEAM, level, done)
                ids, cosine = np.concatenate((old, ids), axis=1), np.concatenate((far, cosine), axis=1)
                best = np.argsort(-cosine, axis=1, kind="stable")[:, :BUILD_BEAM]
                ids, cosine = np.take_along_axis(ids, best, axis=1), np.take_along_axis(cosine, best, axis=1)
            links[new, :LINKS] = _choose(graph.v, ids, cosine, LINKS)
            _link_back(graph.v, links, new)
            done = int(new[-1]) + 1
    graph.entries = _reach(graph.links[0]) if len(v) else graph.entries
    return graph
