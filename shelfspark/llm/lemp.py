"""Maximum inner products by length buckets and sorted coordinate lists, in numpy.

Vectors are integers and scores exact. A *bucket* holds vectors of similar length;
of their directions it keeps every coordinate in a sorted list. For an anchor with
threshold t, a bucket whose longest vector cannot reach t is skipped (and with it all
shorter ones). In the others a vector of score >= t has a cosine of at least
c = t / (|anchor| * longest), so in every coordinate its direction lies in
    a * c -+ sqrt((1 - a^2) * (1 - c^2)),   a being the anchor's direction there.
These ranges are looked up in the lists of the anchor's *focus* coordinates (the
largest ones), and vectors inside all ranges are verified exactly.
"""

from __future__ import annotations

import numpy as np

#: Focus coordinates per anchor.
FOCUS = 6
#: Vectors in a bucket at least; a bucket ends where lengths fall below this part of its longest.
BUCKET_ROWS, SAME_LENGTH = 256, 0.9
#: What rounding may take off a bound in the directions.
SLACK = 1e-9
#: Products and sums below this are exact in double precision.
EXACT = 2.0 ** 53


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of ``q`` with the rows of ``x``, exact whatever their size."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1]
    if bound < EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([sum(a * b for a, b in zip(q.tolist(), row)) for row in x.tolist()], np.int64)


class Bucket:
    """Vectors of similar length (``rows`` into the index) and their sorted coordinate lists."""

    def __init__(self, rows: np.ndarray, directions: np.ndarray, lengths: np.ndarray):
        self.rows = rows
        self.longest = float(lengths.max(initial=0.0))
        self.shortest = float(lengths.min(initial=0.0))
        self.order = np.argsort(directions, axis=0, kind="stable").astype(np.int32)
        self.lists = np.take_along_axis(directions, self.order, 0).T.copy()
        self.order = self.order.T.copy()

    def candidates(self, direction: np.ndarray, length: float, least: float, focus: np.ndarray) -> np.ndarray | None:
        """Index rows that may score ``least`` (> 0) or more; None if no shorter bucket can hold any either."""
        top = length * self.longest * (1 + SLACK)
        if top < least:
            return None
        cosine = max(0.0, min(1.0, least / top - SLACK))
        spread = np.sqrt(max(0.0, 1 - cosine * cosine))
        a = direction[focus]
        off = spread * np.sqrt(np.maximum(0.0, 1 - a * a)) + SLACK
        # A direction at least as near as ``cosine`` reaches beyond the anchor's own coordinate up to its limits.
        low = np.where(a <= -cosine, -1.0, a * cosine - off) - SLACK
        high = np.where(a >= cosine, 1.0, a * cosine + off) + SLACK
        bounds = [(np.searchsorted(self.lists[f], lo, "left"), np.searchsorted(self.lists[f], hi, "right")) for f, lo, hi in zip(focus.tolist(), low, high)]
        met = np.zeros(len(self.rows), np.int8)
        for f, (lo, hi) in zip(focus.tolist(), bounds):
            met[self.order[f, lo:hi]] += 1  # a list holds each vector once
        return self.rows[met == len(focus)]


class Index:
    """All vectors ``x`` of a shard (integers), in buckets of falling length."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        self.x, self.ids, self.labels = x, ids, labels
        real = x.astype(np.float64)
        self.length = np.sqrt((real * real).sum(1))
        direction = real / np.where(self.length > 0, self.length, 1)[:, None]
        order, self.buckets = np.argsort(-self.length, kind="stable"), []
        a = 0
        while a < len(order):
            b = int(np.searchsorted(-self.length[order], -SAME_LENGTH * self.length[order[a]], "right"))
            b = min(len(order), max(b, a + BUCKET_ROWS))
            self.buckets.append(Bucket(order[a:b], direction[order[a:b]], self.length[order[a:b]]))
            a = b

    def search(self, q: np.ndarray, mine, threshold, take) -> None:
        """Gives ``take(rows, scores)`` every vector of ``mine(rows)`` whose score reaches ``threshold()``, bucket by bucket.

        The threshold may rise meanwhile; None stands for no threshold yet."""
        real = q.astype(np.float64)
        length = float(np.sqrt((real * real).sum()))
        direction = real / length if length else real
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            least, rows = threshold(), bucket.rows
            if least is not None and least > 0:
                rows = bucket.candidates(direction, length, float(least), focus)
                if rows is None:
                    return
            elif least is not None and -least > length * bucket.longest * (1 + SLACK):
                pass  # a negative threshold that every vector here reaches
            rows = mine(rows)
            if len(rows):
                take(rows, exact_scores(q, self.x[rows]))

    def positives(self, q: np.ndarray, label, skip: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, scores)`` of the k best vectors of ``label``, ties by smaller id; ``skip`` is the anchor's id and coordinates."""
        best = Best(self.ids, k)

        def mine(rows: np.ndarray) -> np.ndarray:
            rows = rows[self.labels[rows] == label]
            own = self.ids[rows] == skip[0]
            return rows[~(own & (self.x[rows] == skip[1]).all(1))] if own.any() else rows

        self.search(q, mine, best.threshold, best.take)
        return best.rows, best.scores

    def negatives(self, q: np.ndarray, label, ranges: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each score range (low, high) the k best vectors of other labels inside it."""
        best = [Best(self.ids, k, low, high) for low, high in ranges]

        def least():
            return min(b.threshold() for b in best)

        def take(rows: np.ndarray, scores: np.ndarray) -> None:
            for b in best:
                b.take(rows, scores)

        if ranges:
            self.search(q, lambda rows: rows[self.labels[rows] != label], least, take)
        return [(b.rows, b.scores) for b in best]


class Best:
    """The k best rows so far with scores from ``low`` to ``high``, higher scores first, ties by smaller id."""

    def __init__(self, ids: np.ndarray, k: int, low: int | None = None, high: int | None = None):
        self.ids, self.k, self.low, self.high = ids, k, low, high
        self.rows, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def threshold(self) -> int | None:
        if len(self.rows) < self.k:
            return self.low
        return int(self.scores[-1]) if self.low is None else max(self.low, int(self.scores[-1]))

    def take(self, rows: np.ndarray, scores: np.ndarray) -> None:
        inside = np.ones(len(rows), bool)
        least = self.threshold()
        if least is not None:
            inside &= scores >= least
        if self.high is not None:
            inside &= scores <= self.high
        if not inside.any():
            return
        rows, scores = np.concatenate([self.rows, rows[inside]]), np.concatenate([self.scores, scores[inside]])
        order = np.lexsort((rows, self.ids[rows], -scores))[:self.k]
        self.rows, self.scores = rows[order], scores[order]
