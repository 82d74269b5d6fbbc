"""A compressed FM-index over word sequences, and matching statistics by backward search over its wavelet tree.

The sequences stand one behind the other, each closed by symbol 0. Suffixes are sorted
by their first ``DEPTH`` symbols, which is as deep as patterns go. The Burrows-Wheeler
symbols are held as bit-planes with rank directories (a wavelet tree laid out level by
level). All searches of a batch advance together: one backward step is a few numpy
calls per plane for every search that is still on.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which suffixes are sorted; patterns are no longer than this.
DEPTH = 128
#: Suffixes that the fine table of smallest documents looks over at once (a power of two).
FINE = 16
LOW_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of the different keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return out


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols (ties: by place), by prefix doubling from as many symbols as a key holds."""
    n, alphabet = len(symbols), int(symbols.max(initial=0)) + 2
    h = max(1, min(n, 62 // alphabet.bit_length()))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key *= alphabet
        key[:n - j] += symbols[j:] + 1
    rank = dense(key)
    while h < depth and int(rank.max(initial=0)) < n - 1:
        after = np.zeros(n, np.int64)
        after[:n - h] = rank[h:] + 1
        rank = dense(rank * (n + 2) + after)
        h *= 2
    return np.argsort(rank, kind="stable")


class WaveletTree:
    """Bit-planes of ``symbols``, highest bit first, each over the order that the planes above leave."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        order = symbols.astype(np.uint32)
        self.words, self.before, self.zeros = [], [], []
        for p in range(self.bits - 1, -1, -1):
            one = (order >> np.uint32(p) & np.uint32(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.pad(packed, (0, 8 - len(packed) % 8)).view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(one) - one.sum()))
            order = np.concatenate([order[~one], order[one]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a symbol's occurrences before ``at`` end behind the last plane."""
        for p in range(self.bits):
            word = at >> 6
            ones = self.before[p][word] + np.bitwise_count(self.words[p][word] & LOW_BITS[at & 63])
            bit = symbols >> (self.bits - 1 - p) & 1
            at = np.where(bit == 1, self.zeros[p] + ones, at - ones)
        return at


class SmallestDocument:
    """The smallest document among suffixes first..last-1: a fine sparse table, and one over blocks of ``FINE``."""

    def __init__(self, docs: np.ndarray):
        self.fine = [docs.astype(np.int32)]
        while 1 << len(self.fine) <= min(FINE, len(docs)):
            self.fine.append(self._next(self.fine))
        whole = len(docs) // FINE * FINE
        self.coarse = [docs[:whole].reshape(-1, FINE).min(1).astype(np.int32)] if whole else []
        while self.coarse and 1 << len(self.coarse) <= len(self.coarse[0]):
            self.coarse.append(self._next(self.coarse))

    @staticmethod
    def _next(levels: list[np.ndarray]) -> np.ndarray:
        half = 1 << (len(levels) - 1)
        return np.minimum(levels[-1][:-half], levels[-1][half:])

    @staticmethod
    def _lookup(levels: list[np.ndarray], first: np.ndarray, size: np.ndarray, out: np.ndarray, where: np.ndarray) -> None:
        level = np.frexp(size[where].astype(np.float64))[1] - 1
        level = np.minimum(level, len(levels) - 1)
        for x in np.unique(level):
            mine = where[level == x]
            a = first[mine]
            out[mine] = np.minimum(out[mine], np.minimum(levels[x][a], levels[x][a + size[mine] - (1 << int(x))]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        size = last - first
        out = np.full(len(first), np.iinfo(np.int32).max, np.int32)
        self._lookup(self.fine, first, size, out, np.flatnonzero(size > 0))  # beyond 2 * FINE: both ends only
        block, end = -(-first // FINE), last // FINE
        self._lookup(self.coarse, block, end - block, out, np.flatnonzero((size > 2 * FINE) & (end > block)))
        return out


class FmIndex:
    """Sequences of dense symbols (from 1) with their documents' ranks."""

    def __init__(self, symbols: np.ndarray, document: np.ndarray, depth: int = DEPTH):
        """``symbols``: the sequences, each closed by a 0; ``document``: the rank of each place's document."""
        self.symbols = symbols
        order = suffix_order(symbols, depth)
        alphabet = int(symbols.max(initial=0)) + 1
        self.tree = WaveletTree(symbols[order - 1], alphabet)
        self.smallest = SmallestDocument(document[order])
        counts = np.bincount(symbols, minlength=alphabet)
        every = np.arange(alphabet)
        # A symbol's block among the sorted suffixes, less its block behind the last plane.
        self.shift = np.cumsum(counts) - counts - self.tree.descend(every, np.zeros(alphabet, np.int64))

    def step(self, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of the patterns with ``symbols`` put in front."""
        both = self.tree.descend(np.concatenate([symbols, symbols]), np.concatenate([first, last]))
        n, shift = len(symbols), self.shift[symbols]
        return both[:n] + shift, both[n:] + shift

    def matches(self, start: np.ndarray, end: np.ndarray, document: np.ndarray, least: int) -> np.ndarray:
        """For streamed stretches ``start..end-1`` (places of the indexed text, at most ``DEPTH`` long) of documents of rank ``document``:
        a mark per place where a window of ``least`` symbols begins that also begins in a smaller document.

        Each stretch is read from its right end: the pattern grows to the left as long
        as a smaller document holds it. What is ``least`` long or longer is an interval
        whose windows all match. Where the pattern fails at a place k, the stretch left of k
        is read on, and the windows over k that the interval does not hold are searched one by one.
        """
        n = len(self.symbols)
        edges = np.zeros(n + 1, np.int64)
        live = np.flatnonzero(end - start >= least)
        start, right, document = start[live], end[live] - 1, document[live]
        at, first, last, alone = right.copy(), np.zeros(len(live), np.int64), np.full(len(live), n), np.zeros(len(live), bool)
        while len(start):
            a, b = self.step(self.symbols[at], first, last)
            on = (b > a) & (self.smallest.of(a, b) < document)
            first, last = np.where(on, a, first), np.where(on, b, last)
            at = at - on
            stop = ~on | (at < start)
            if not stop.any():
                continue
            s = np.flatnonzero(stop)
            long = s[right[s] - at[s] >= least]
            np.add.at(edges, at[long] + 1, 1)
            np.add.at(edges, right[long] - least + 2, -1)
            s = s[~alone[s] & (at[s] >= start[s])]
            fail = at[s]
            # Windows over the place of failure that end before the pattern did, or less than a window behind that place.
            low = np.maximum(start[s], fail - least + 1)
            count = np.maximum(0, np.minimum(right[s] - 1, fail + least - 1) - least + 2 - low)
            new = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            rest = s[fail - start[s] >= least]
            keep = ~stop
            start, right, document, at, first, last, alone = (np.concatenate([x[keep], y, z]) for x, y, z in (
                (start, start[rest], new), (right, at[rest] - 1, new + least - 1), (document, document[rest], np.repeat(document[s], count)),
                (at, at[rest] - 1, new + least - 1), (first, np.zeros(len(rest), np.int64), np.zeros(len(new), np.int64)),
                (last, np.full(len(rest), n), np.full(len(new), n)), (alone, np.zeros(len(rest), bool), np.ones(len(new), bool))))
        return np.cumsum(edges)[:n] > 0
