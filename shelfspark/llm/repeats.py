"""Repeats in byte strings: anchored runs of windows, and maximal repeats by the LCP-interval tree of an enhanced suffix array."""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np

from shelfspark.llm.words import CODES, INVERSE, STEP, mixed, powers

#: Bytes of an anchor: the smallest hash among a window's ANCHOR-grams.
ANCHOR = 48
#: Symbols packed into the first sort key: 257**7 < 2**63.
PACKED = 7
#: Bytes compared at once, and the depth from which ranks are kept for comparisons.
WORD, KEPT = 8, 112
#: Places that a pass over sorted keys holds at once.
PART = 1 << 16


def running_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODES[data] * powers(STEP, len(data)), dtype=np.uint64)])


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


class Runs:
    """Runs of windows of several texts: neighbouring windows of ``size`` bytes with the same anchor value.

    ``text``, ``start`` (in the text), ``count`` (windows), ``anchor`` and ``content``
    (hash of the run's bytes) are arrays over the runs; ``inner`` marks runs that
    hold their anchor at several places, so that windows may repeat inside.
    """

    def __init__(self, texts: list[bytes], size: int, anchor: int = ANCHOR):
        grams = size - anchor + 1
        data = np.frombuffer(b"".join(texts) + bytes(size), np.uint8)
        n = len(data) - size
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        inverse = powers(INVERSE, len(data) + 1)
        run = running_hash(data)
        gram = mixed((run[anchor:] - run[:-anchor]) * inverse[:len(run) - anchor])
        least = sliding(gram, grams, np.minimum)[:n]
        owner = np.repeat(np.arange(len(texts)), length)
        inside = np.arange(n) - begin[owner] + size <= length[owner] if n else np.zeros(0, bool)
        new = inside.copy()
        if n:
            new[1:] &= (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        self.text = owner[first]
        self.start = first - begin[self.text]
        following = np.append(first[1:], 0)
        last = begin[self.text] + length[self.text] - size + 1
        same = np.append(self.text[1:] == self.text[:-1], False)
        self.count = np.where(same, following, last) - first
        self.anchor = least[first]
        end = first + self.count - 1 + size
        self.content = mixed((run[end] - run[first]) * inverse[first] + (end - first).astype(np.uint64))
        self.inner = self._inner(gram, first, end - anchor)

    @staticmethod
    def _inner(gram: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether a run's anchor value stands at two or more places from ``first`` to ``last``."""
        out = np.zeros(len(first), bool)
        if not len(first):
            return out
        width = int((last - first).max()) + 1
        for a in range(0, len(first), max(1, (1 << 21) // width)):
            part = slice(a, a + max(1, (1 << 21) // width))
            size = last[part] - first[part] + 1
            at = np.repeat(first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
            hit = gram[at] == np.repeat(gram_values(gram, first[part], last[part]), size)
            out[part] = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size) > 1
        return out


def gram_values(gram: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest gram of each run (the anchor's value)."""
    size = last - first + 1
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.minimum.reduceat(gram[at], np.cumsum(size) - size)


class SuffixArray:
    """Suffixes of several strings that start at their first ``count`` places, sorted, with LCP values and left symbols.

    Sorted by prefix doubling; comparisons end at a string's end, which is smaller than any byte.
    Held at once are at most some 50 bytes per place: ranks are kept from depth ``KEPT`` on, and
    what two suffixes share below it is compared in words of eight bytes.
    """

    def __init__(self, strings: list[bytes], counts: list[int]):
        size = np.array([len(s) for s in strings], np.int64)
        self.begin = np.cumsum(size + 1) - size - 1  # one free place behind each string
        self.places = n = int((size + 1).sum())
        raw = b"\0".join(strings) + bytes(1 + WORD)
        data = np.frombuffer(raw, np.uint8, n)
        left = np.repeat((self.begin + size).astype(np.int32), size + 1)
        left -= np.arange(n, dtype=np.int32)  # symbols up to the end
        levels = self._levels(data, left, int(size.max(initial=0)))
        counts = np.array(counts, np.int64)
        starts = np.repeat((self.begin - np.cumsum(counts) + counts).astype(np.int32), counts)
        starts += np.arange(len(starts), dtype=np.int32)
        order = np.argsort(levels[-1][1][starts], kind="stable")
        self.at, self.string = starts[order], np.repeat(np.arange(len(strings), dtype=np.int32), counts)[order]
        del starts, order
        self.left_symbol = np.where(self.at > self.begin[self.string], data[self.at - 1].astype(np.int16), np.int16(-1))  # -1: nothing, or unknown
        i, j = self.at[:-1], self.at[1:]
        lcp, room = np.zeros(len(i), np.int32), np.minimum(left[i], left[j])
        while levels:
            h, rank = levels.pop()
            on = np.flatnonzero(lcp < room)
            on = on[rank[i[on] + lcp[on]] == rank[j[on] + lcp[on]]]
            lcp[on] += np.int32(h)
            del rank
        words = np.ndarray((n,), "<u8", raw, 0, (1,))
        on = np.flatnonzero(lcp < room)
        while len(on):  # what is left is shorter than the lowest level kept
            differ = words[i[on] + lcp[on]] ^ words[j[on] + lcp[on]]
            shared = np.bitwise_count((differ & -differ) - np.uint64(1)) // np.uint8(8)  # equal bytes in front
            lcp[on] += shared
            on = on[(shared == WORD) & (lcp[on] < room[on])]
        self.lcp = np.concatenate([np.zeros(1, np.int32), np.minimum(lcp, room)]) if len(self.at) else lcp

    @classmethod
    def _levels(cls, data: np.ndarray, left: np.ndarray, longest: int) -> list[tuple[int, np.ndarray]]:
        """``(depth, rank by as many symbols)`` from depth ``KEPT`` on; the last one sorts whole suffixes."""
        n = len(data)
        symbols = data.astype(np.int16) + np.int16(1)
        key = np.zeros(n, np.int64)
        for j in range(PACKED):
            key *= 257
            key[:max(0, n - j)] += symbols[j:] * (left[:max(0, n - j)] > j)
        del symbols
        levels: list[tuple[int, np.ndarray]] = []
        rank, h = cls._rank(key), PACKED
        while h < longest:
            if h >= KEPT:
                levels.append((h, rank))
            key[:] = rank
            key *= n + 2
            key[:n - h] += (rank[h:] + np.int32(1)) * (left[:n - h] > h)
            classes, rank = rank.max(), cls._rank(key)
            if rank.max() == classes:  # deeper symbols tell nothing more apart
                levels, h = levels[:-1] if h >= KEPT else levels, longest
            else:
                h *= 2
        return [*levels, (h, rank)]

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.zeros(len(key), bool)
        for a in range(1, len(key), PART):
            ordered = key[order[a - 1:a + PART]]
            np.not_equal(ordered[1:], ordered[:-1], out=new[a:a + PART])
        out = np.empty(len(key), np.int32)
        out[order] = np.cumsum(new, dtype=np.int32)
        return out

    def maximal(self, least: int) -> np.ndarray:
        """Rows of length, first, last: intervals of the suffix array whose suffixes share ``length`` symbols, at least ``least``.

        One stack scan over the LCP values builds the interval tree; an interval is
        given out when the symbols to the left of its suffixes differ, so that it
        cannot be extended to the left (to the right it cannot by construction).
        """
        out = array("i")
        deep = self.lcp >= least
        edges = np.flatnonzero(np.diff(deep, prepend=False, append=False)).tolist()
        fresh = np.zeros(len(self.at), bool)
        fresh[1:] = (self.left_symbol[1:] != self.left_symbol[:-1]) | (self.left_symbol[1:] < 0)
        change, lcps = memoryview(np.cumsum(fresh, dtype=np.int32)), memoryview(self.lcp)
        for a, b in zip(edges[::2], edges[1::2]):  # between blocks the stack is empty
            stack: list[tuple[int, int]] = []
            for i, value in enumerate(chain(lcps[a:b], (0,)), a):
                lb = i - 1
                while stack and stack[-1][0] > value:
                    length, lb = stack.pop()
                    if change[i - 1] > change[lb]:
                        out.extend((length, lb, i - 1))
                if value and (not stack or stack[-1][0] < value):
                    stack.append((value, lb))
        return np.array(out, np.int32).reshape(-1, 3)

    def covered(self, least: int) -> np.ndarray:
        """A mark per place of the joined strings that some occurrence of a maximal repeat covers."""
        reach = np.zeros(len(self.at), np.int32)
        found = self.maximal(least)
        found = found[np.argsort(found[:, 0], kind="stable")]  # longer repeats, deeper in the tree, paint over shorter ones
        for length, first, last in zip(*map(memoryview, np.ascontiguousarray(found.T))):
            reach[first:last + 1] = length
        edges = np.zeros(self.places + 1, np.int32)
        hit = reach > 0
        np.add.at(edges, self.at[hit], 1)
        np.add.at(edges, self.at[hit] + reach[hit], -1)
        return np.cumsum(edges, dtype=np.int32)[:-1] > 0
