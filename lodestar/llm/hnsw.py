"""A hierarchical navigable small-world graph over unit vectors, for many queries at once.

Nodes are leaders: a vector within ``ball`` of one that is already a node joins it as a member and gets no node of its
own, so groups of near copies, however large, are one node. Level l holds the first ``1 / DEGREE ** l`` of the nodes.
Queries go side by side through every level: all of them extend the best open entries of their beams in the same step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Links of a node on the upper levels; twice as many on the lowest.
DEGREE = 16

#: Beam while building, vectors inserted at once, and queries that go side by side.
BUILD_BEAM, INSERTED, ABREAST = 48, 512, 512

#: Open entries of a beam that are extended in one step.
EXTENDED = 4


def _levels(n: int) -> list[int]:
    """How many of n nodes stand on each level."""
    sizes = [n]
    while sizes[-1] > DEGREE:
        sizes.append(-(-sizes[-1] // DEGREE))
    return sizes


def width(level: int) -> int:
    """Links of a node on a level."""
    return DEGREE if level else 2 * DEGREE


@dataclass
class Graph:
    """``vectors`` of the nodes, their links by level (-1: none), and the node that each row has joined."""

    vectors: np.ndarray
    links: list[np.ndarray]
    leader: np.ndarray
    size: int = 0
    rows: list[int] = field(default_factory=list)  # of each node, the row that it is

    @classmethod
    def build(cls, unit: np.ndarray, ball: float) -> Graph:
        """The graph of some rows; ``ball`` is the least cosine to a leader."""
        n, dims = unit.shape
        links = [np.full((size, width(level)), -1, np.int32) for level, size in enumerate(_levels(n))]
        graph = cls(np.zeros((n, dims), np.float32), links, np.full(n, -1, np.int32))
        first = 0
        while first < n:
            step = min(INSERTED, max(64, graph.size // 2))
            graph._insert(unit[first : first + step], first, ball)
            first += step
        graph.vectors = graph.vectors[: graph.size]
        graph.links = [own[: graph.size] for own in graph.links]
        return graph

    def _insert(self, batch: np.ndarray, first: int, ball: float) -> None:
        near, sims = self.search(batch, BUILD_BEAM)
        joins = sims[:, 0] >= ball if self.size else np.zeros(len(batch), bool)
        self.leader[first : first + len(batch)][joins] = near[joins, 0] if self.size else 0
        # The others become nodes, unless one of them before is a leader to them.
        rest = np.flatnonzero(~joins)
        between = batch[rest] @ batch[rest].T
        within = between >= ball
        chosen: list[int] = []
        if np.count_nonzero(within) > len(rest):
            for i in range(len(rest)):
                earlier = [j for j in chosen if within[i, j]]
                if earlier:
                    self.leader[first + rest[i]] = self.size + chosen.index(max(earlier, key=lambda j: between[i, j]))
                else:
                    chosen.append(i)
        else:
            chosen = list(range(len(rest)))
        if not chosen:
            return
        picked = rest[chosen]
        nodes = np.arange(self.size, self.size + len(picked), dtype=np.int32)
        self.leader[first + picked] = nodes
        self.rows += (first + picked).tolist()
        vectors, between = batch[picked], between[np.ix_(chosen, chosen)]
        self.vectors[nodes] = vectors
        np.fill_diagonal(between, -np.inf)
        for level, own in enumerate(self.links):
            there = int(np.searchsorted(nodes, len(own)))
            if not there:
                break
            if level:
                found, close = self._from_top(vectors[:there], BUILD_BEAM, level)
            else:
                found, close = near[picked], sims[picked]
            found = np.concatenate((found, np.broadcast_to(nodes[:there], (there, there))), axis=1)
            close = np.concatenate((close, between[:there, :there]), axis=1)
            self._link(own, nodes[:there], found, close)
        self.size += len(picked)

    def _link(self, own: np.ndarray, nodes: np.ndarray, found: np.ndarray, close: np.ndarray) -> None:
        """Link new nodes to some of what was found near them, and back."""
        kept = self._diverse(found, close, DEGREE)
        own[nodes, : kept.shape[1]] = kept
        source, target = np.repeat(nodes, kept.shape[1]), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, starts, counts = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), counts.max(initial=0)), -1, np.int32)
        back[np.repeat(np.arange(len(ends)), counts), np.arange(len(target)) - np.repeat(starts, counts)] = source
        old = own[ends]
        new = np.concatenate((old, back), axis=1)
        full = np.count_nonzero(new >= 0, axis=1) > own.shape[1]
        # Where there is room the new links go behind the old ones; elsewhere all are chosen anew.
        room = np.argsort(new[~full] < 0, axis=1, kind="stable")[:, : own.shape[1]]
        own[ends[~full]] = np.take_along_axis(new[~full], room, axis=1)
        for a in range(0, int(full.sum()), ABREAST):
            at, some = ends[full][a : a + ABREAST], new[full][a : a + ABREAST]
            sims = np.einsum("nd,nkd->nk", self.vectors[at], self.vectors[some])
            kept = self._diverse(some, np.where(some >= 0, sims, -np.inf), own.shape[1])
            own[at] = -1
            own[at, : kept.shape[1]] = kept

    def _diverse(self, found: np.ndarray, close: np.ndarray, most: int) -> np.ndarray:
        """Of the entries of each row so many: first those that are nearer to the row than to any chosen before, then
        the nearest of the others."""
        wide = min(found.shape[1], 4 * most)
        order = np.argsort(-close, axis=1, kind="stable")[:, :wide]
        found, close = np.take_along_axis(found, order, axis=1), np.take_along_axis(close, order, axis=1)
        out = np.full((len(found), min(most, wide)), -1, np.int32)
        for a in range(0, len(found), ABREAST):
            ids, sims = found[a : a + ABREAST], close[a : a + ABREAST]
            real = np.isfinite(sims)
            vectors = self.vectors[ids]
            between = np.matmul(vectors, vectors.transpose(0, 2, 1))
            chosen = np.zeros(ids.shape, bool)
            for c in range(ids.shape[1]):
                covered = (chosen[:, :c] & (between[:, c, :c] > sims[:, c : c + 1])).any(axis=1)
                chosen[:, c] = real[:, c] & ~covered & (chosen[:, :c].sum(axis=1) < most)
            first = np.argsort(np.where(chosen, 0, np.where(real, 1, 2)), axis=1, kind="stable")[:, : out.shape[1]]
            out[a : a + ABREAST] = np.where(np.take_along_axis(real, first, axis=1), np.take_along_axis(ids, first, axis=1), -1)
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes that a beam finds for each query, nearest first (-1 and minus infinity: none)."""
        parts = [self._from_top(queries[a : a + ABREAST], beam, 0) for a in range(0, len(queries), ABREAST)]
        if not parts:
            return np.empty((0, beam), np.int32), np.empty((0, beam), np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _from_top(self, queries: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros((len(queries), 1), np.int32)
        for upper in range(len(self.links) - 1, level, -1):
            entry = self._beam(queries, entry, 1, upper)[0]
        return self._beam(queries, entry, beam, level)

    def _beam(self, queries: np.ndarray, entry: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        n, size, links = len(queries), min(self.size, len(self.links[level])), self.links[level]
        ids, sims = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32)
        if not size or not n:
            return ids, sims
        ids[:, 0] = entry[:, 0]
        sims[:, 0] = np.einsum("nd,nd->n", queries, self.vectors[entry[:, 0]])
        is_open = np.zeros((n, beam), bool)
        is_open[:, 0] = True
        seen = np.zeros(n * size, bool)
        seen[np.arange(n) * size + entry[:, 0]] = True
        marks = np.empty(n * size, np.int32)
        at = np.arange(n)
        while True:
            at = at[is_open[at].any(axis=1)]
            if not len(at):
                return ids, sims
            # Beams stand in order, so the first open entries are the best.
            place = np.argsort(~is_open[at], axis=1, kind="stable")[:, :EXTENDED]
            extended = np.where(np.take_along_axis(is_open[at], place, axis=1), np.take_along_axis(ids[at], place, axis=1), -1)
            is_open[at[:, None], place] = False
            reached = np.where(extended[:, :, None] >= 0, links[extended], -1).reshape(len(at), -1)
            row, column = np.nonzero(reached >= 0)
            node = reached[row, column].astype(np.int64)
            key = at[row] * size + node
            fresh = ~seen[key]
            row, node, key = row[fresh], node[fresh], key[fresh]
            number = np.arange(len(key), dtype=np.int32)
            marks[key] = number
            once = marks[key] == number
            row, node, key = row[once], node[once], key[once]
            seen[key] = True
            close = np.einsum("nd,nd->n", queries[at[row]], self.vectors[node])
            better = close > sims[at[row], -1]
            row, node, close = row[better], node[better], close[better]
            if not len(row):
                continue
            counts = np.bincount(row, minlength=len(at))
            touched = np.flatnonzero(counts)
            own = at[touched]
            slot = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_sims = np.full((len(at), counts.max()), -np.inf, np.float32)
            new_ids = np.full(new_sims.shape, -1, np.int32)
            new_sims[row, slot], new_ids[row, slot] = close, node
            all_sims = np.concatenate((sims[own], new_sims[touched]), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[own] = np.take_along_axis(all_sims, order, axis=1)
            ids[own] = np.take_along_axis(np.concatenate((ids[own], new_ids[touched]), axis=1), order, axis=1)
            opened = np.concatenate((is_open[own], new_ids[touched] >= 0), axis=1)
            is_open[own] = np.take_along_axis(opened, order, axis=1)
