"""A hierarchical navigable small-world graph over unit vectors, in numpy; searches run for many queries at once."""

from __future__ import annotations

import numpy as np

DEGREE = 12
BUILD_BEAM = 48
BEAMS_FROM = 32
#: Bytes of visited marks that a group of queries may use.
VISITED = 32 << 20
EXPANDED = 4


def diverse(near: np.ndarray, ids: np.ndarray, sims: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (best first, -1: none) that are nearer to the row than to a chosen one; then the best of the rest."""
    rows, width = ids.shape
    vectors = x[np.maximum(ids, 0)]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    chosen = np.zeros((rows, width), bool)
    for j in range(width):
        apart = np.where(chosen, between[:, j], -2.0).max(1) < sims[:, j]
        chosen[:, j] = apart & (ids[:, j] >= 0) & (chosen.sum(1) < degree)
    rank = np.where(chosen, 0, width) + np.arange(width)
    rank = np.where(ids >= 0, rank, 4 * width)
    order = np.argsort(rank, axis=1)[:, :degree]
    return np.take_along_axis(ids, order, 1)


class Level:
    """One level: its nodes (numbers in the whole graph) and, per node, its neighbours as places in ``nodes`` (-1: none)."""

    def __init__(self, nodes: np.ndarray, links: np.ndarray):
        self.nodes, self.links = nodes, links


class Hnsw:
    """Vectors ``x`` (unit length, float32), levels from the lowest (all nodes) to the highest."""

    def __init__(self, x: np.ndarray, levels: list[Level], beam: int = BEAMS_FROM):
        self.x, self.levels, self.beam = x, levels, beam

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5, degree: int = DEGREE) -> Hnsw:
        n = len(x)
        r = np.random.default_rng(seed)
        height = np.floor(-np.log(1 - r.random(n)) / np.log(degree)).astype(np.int64) if n else np.zeros(0, np.int64)
        graph = cls(x, [])
        order = r.permutation(n)
        levels: list[Level] = []
        for level in range(int(height.max()) if n else 0, -1, -1):
            upper = levels[-1] if levels else None
            graph.levels = levels[::-1]
            levels.append(graph._level(order[height[order] >= level], upper, 2 * degree if level == 0 else degree))
        graph.levels = levels[::-1]
        return graph

    def _level(self, nodes: np.ndarray, upper: Level | None, degree: int) -> Level:
        """Nodes enter in doubling batches; each takes diverse neighbours among a beam search and its own batch."""
        x, n = self.x[nodes], len(nodes)
        links = np.full((n, degree), -1, np.int64)
        place = np.full(len(self.x), -1, np.int64)
        place[nodes] = np.arange(n)
        done = 0
        while done < n:
            batch = np.arange(done, min(n, done + max(64, min(done, 1024))))
            inner = x[batch] @ x[batch].T
            np.fill_diagonal(inner, -2)
            k = min(BUILD_BEAM, len(batch))
            top = np.argsort(-inner, 1)[:, :k]
            ids, sims = batch[top], np.take_along_axis(inner, top, 1)
            ids = np.where(sims > -2, ids, -1)
            if done:
                entry = None
                if upper is not None:
                    found, _ = self.search(x[batch], 1, raw=True)
                    entry = place[found[:, 0]]
                    entry = np.where((entry >= 0) & (entry < done), entry, 0)
                old, near = beam_search(x, links, x[batch], BUILD_BEAM, entry, done)
                ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, near], 1)
                best = np.argsort(-np.where(ids >= 0, sims, -3), 1)[:, :BUILD_BEAM]
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            links[batch] = _padded(diverse(x[batch], ids, sims, x, degree // 2 if degree > 12 else degree), degree)
            self._back(x, links, batch, degree)
            done = int(batch[-1]) + 1
        return Level(nodes, links)

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, batch: np.ndarray, degree: int) -> None:
        """The links of the batch the other way round; a node with too many keeps diverse ones."""
        source, target = np.repeat(batch, links.shape[1]), links[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        held = np.unique(target)
        old = links[held]
        a = np.concatenate([np.repeat(held, links.shape[1])[old.reshape(-1) >= 0], target])
        b = np.concatenate([old.reshape(-1)[old.reshape(-1) >= 0], source])
        pair = np.unique(a * len(x) + b)
        a, b = pair // len(x), pair % len(x)
        sims = np.einsum("nd,nd->n", x[a], x[b])
        order = np.lexsort((-sims, a))
        a, b, sims = a[order], b[order], sims[order]
        starts = np.searchsorted(a, held)
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        keep = rank < 4 * degree  # the nearest are looked at
        row = np.searchsorted(held, a[keep])
        ids = np.full((len(held), 4 * degree), -1, np.int64)
        near = np.full((len(held), 4 * degree), -3, np.float32)
        ids[row, rank[keep]], near[row, rank[keep]] = b[keep], sims[keep]
        full = (ids >= 0).sum(1) > degree
        links[held[~full]] = ids[~full, :degree]
        for part in np.array_split(np.flatnonzero(full), max(1, int(full.sum()) // 512)):
            if len(part):
                links[held[part]] = _padded(diverse(x[held[part]], ids[part], near[part], x, degree), degree)

    def search(self, q: np.ndarray, beam: int, raw: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``(nodes, similarities)`` of the ``beam`` nearest found for each query, best first, -1 where there are fewer."""
        group = max(16, min(1024, VISITED // max(1, len(self.x))))
        parts = [self._search(q[a:a + group], beam) for a in range(0, len(q), group)]
        if not parts:
            return np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry, ids, sims = None, None, None
        for i in range(len(self.levels) - 1, -1, -1):
            level = self.levels[i]
            wide = beam if i == 0 else min(beam, 4)
            ids, sims = beam_search(self.x[level.nodes] if i else self._lowest(), level.links, q, wide, entry, len(level.nodes))
            ids = np.where(ids >= 0, level.nodes[np.maximum(ids, 0)], -1)
            if i:
                below = np.full(len(self.x), -1, np.int64)
                below[self.levels[i - 1].nodes] = np.arange(len(self.levels[i - 1].nodes))
                entry = below[ids[:, 0]]
        return ids, sims

    def _lowest(self) -> np.ndarray:
        if getattr(self, "_x0", None) is None or len(self._x0) != len(self.levels[0].nodes):
            self._x0 = np.ascontiguousarray(self.x[self.levels[0].nodes])
        return self._x0

    def audited(self, cosine: float, wanted: float, samples: int = 256, seed: int = 9) -> Hnsw:
        """Widens the beam until searches for planted neighbours at about the given cosine find ``wanted`` of them."""
        n, d = self.x.shape
        r = np.random.default_rng(seed)
        at = r.choice(n, min(n, samples), replace=False)
        noise = r.normal(size=(len(at), d))
        noise -= (noise * self.x[at]).sum(1, keepdims=True) * self.x[at]
        noise /= np.maximum(1e-12, np.linalg.norm(noise, axis=1, keepdims=True))
        q = (cosine * self.x[at] + np.sqrt(1 - cosine ** 2) * noise).astype(np.float32)
        # A planted neighbour counts as found if it, or enough nodes as near as it, are in the beam.
        while self.beam < n:
            ids, sims = self.search(q, self.beam)
            found = (ids == at[:, None]).any(1) | (sims[:, -1] >= cosine - 1e-3)
            if found.mean() >= wanted:
                break
            self.beam *= 2
        self.beam = min(self.beam, max(n, 1))
        return self

    def within(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` of similarities of at least ``least``: a beam that is full of such nodes is searched again, wider."""
        queries, nodes = [], []
        left, beam = np.arange(len(q)), self.beam
        while len(left):
            ids, sims = self.search(q[left], beam)
            more = (sims[:, -1] >= least) if beam < len(self.x) else np.zeros(len(left), bool)
            hit = (sims >= least) & (ids >= 0) & ~more[:, None]
            queries.append(np.repeat(left, hit.sum(1)))
            nodes.append(ids[hit])
            left, beam = left[more], min(4 * beam, len(self.x))
        return np.concatenate(queries or [np.zeros(0, np.int64)]), np.concatenate(nodes or [np.zeros(0, np.int64)])


def _padded(ids: np.ndarray, width: int) -> np.ndarray:
    return np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1) if ids.shape[1] < width else ids[:, :width]


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int, entry: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best places of a level for each query, among the first ``n``; a beam as wide as the level looks at all."""
    rows = len(q)
    if beam >= n:
        sims = q @ x[:n].T
        order = np.argsort(-sims, 1)
        pad = ((0, 0), (0, beam - n))
        return (np.pad(order, pad, constant_values=-1), np.pad(np.take_along_axis(sims, order, 1), pad, constant_values=-3).astype(np.float32))
    ids = np.full((rows, beam), -1, np.int64)
    sims = np.full((rows, beam), -3, np.float32)
    open_ = np.zeros((rows, beam), bool)
    seen = np.zeros((rows, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    ids[:, 0] = 0 if entry is None else entry
    sims[:, 0] = np.einsum("qd,qd->q", q, x[ids[:, 0]])
    open_[:, 0] = True
    seen[np.arange(rows), ids[:, 0]] = True
    live = np.arange(rows)
    while len(live):
        first = np.argsort(~open_[live], axis=1, kind="stable")[:, :EXPANDED]  # beams are sorted: the best open places
        is_open = np.take_along_axis(open_[live], first, 1)
        places = np.where(is_open, np.take_along_axis(ids[live], first, 1), -1)
        open_[live[:, None], first] = False
        new = np.where(places[:, :, None] >= 0, links[places], -1).reshape(len(live), -1)
        new = np.sort(np.where((new >= 0) & (new < n), new, n), axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new[seen[live[:, None], new]] = n
        width = int((new < n).sum(1).max(initial=0))
        if width:
            new = np.sort(new, axis=1)[:, :width]
            seen[live[:, None], new] = True
            near = np.matmul(x[np.minimum(new, n - 1)], q[live][:, :, None])[:, :, 0]
            near = np.where(new < n, near, np.float32(-3))
            all_sims = np.concatenate([sims[live], near], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_sims, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new < n, new, -1)], 1), order, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new < n], 1), order, 1)
        live = live[open_[live].any(1)]
    return ids, sims
