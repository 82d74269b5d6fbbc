"""A wavelet matrix: token ids as succinct bit-planes with rank and select."""

from __future__ import annotations

import numpy as np

#: Bits between two entries of a plane's rank directory.
BLOCK = 512


class WaveletMatrix:
    """``bits`` planes over ``n`` tokens, highest bit first.

    Plane p holds bit p of the tokens in the order left by the planes above:
    stably, zeros before ones. ``zeros[p]`` counts its zeros; ``ranks[p][b]`` the
    ones before block b.
    """

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, tokens: np.ndarray, bits: int) -> WaveletMatrix:
        order, planes, ranks, zeros = np.ascontiguousarray(tokens), [], [], []
        for p in range(bits - 1, -1, -1):
            one = (order >> order.dtype.type(p) & order.dtype.type(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            padded = np.pad(packed, (0, -len(packed) % (BLOCK // 8)))
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)]))
            zeros.append(int(len(order) - ones.sum()))
            order = np.concatenate([order.compress(~one), order.compress(one)])
        return cls(len(tokens), planes, ranks, zeros)

    def bit(self, p: int, i: int) -> int:
        return int(self.planes[p][i >> 3]) >> (i & 7) & 1

    def ones(self, p: int, i: int) -> int:
        """Ones of plane p before position i."""
        block = i // BLOCK
        part = self.planes[p][block * BLOCK // 8:(i + 7) // 8]
        total = int(self.ranks[p][block]) + int(np.bitwise_count(part).sum())
        return total - (int(part[-1]) >> (i & 7)).bit_count() if i & 7 and len(part) else total

    def _place(self, p: int, one: bool, k: int) -> int:
        """Position in plane p of its k-th one or zero, by halving the rank directory."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            before = self.ones(p, mid + 1)
            if (before if one else mid + 1 - before) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def access(self, i: int) -> int:
        """The token at position i."""
        token = 0
        for p in range(len(self.planes)):
            one = self.bit(p, i)
            token = token << 1 | one
            i = self.zeros[p] + self.ones(p, i) if one else i - self.ones(p, i)
        return token

    def _interval(self, token: int, upto: int) -> tuple[int, int]:
        """Where the token's occurrences before ``upto`` stand behind the last plane."""
        lo, hi, last = 0, upto, len(self.planes) - 1
        if token >> len(self.planes):
            return 0, 0
        for p in range(len(self.planes)):
            a, b = self.ones(p, lo), self.ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> (last - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, upto: int | None = None) -> int:
        """Occurrences of the token before ``upto`` (all, if None)."""
        lo, hi = self._interval(token, self.n if upto is None else upto)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence, counted from 0."""
        lo, hi = self._interval(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i, last = lo + k, len(self.planes) - 1
        for p in range(last, -1, -1):
            one = bool(token >> (last - p) & 1)
            i = self._place(p, one, i - self.zeros[p] if one else i)
        return i

    def positions(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def tokens(self) -> np.ndarray:
        """All tokens in their order: the planes undone from the last to the first."""
        out = np.zeros(self.n, np.uint32)
        for p in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            at = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
            out[self.zeros[p]:] |= np.uint32(1 << (len(self.planes) - 1 - p))
            back = np.empty_like(out)
            back[at] = out
            out = back
        return out
