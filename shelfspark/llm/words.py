"""Words of many texts at once: byte bounds, hashes, and hashes of word windows, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that belong to words: digits, letters after lower-casing, and all of a non-ASCII character; or all but blanks.
ALPHANUMERIC = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CODES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "big") for b in range(256)], np.uint64)


#: Powers that a process keeps for each base (8 bytes each): those of a usual slice of texts.
KEPT_POWERS = (1 << 20) + (1 << 14)
_kept: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, read-only if kept."""
    def made(n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    if n > KEPT_POWERS:
        return made(n)
    if int(base) not in _kept:
        _kept[int(base)] = made(KEPT_POWERS)
        _kept[int(base)].flags.writeable = False
    return _kept[int(base)][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads high bits over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts: byte bounds in one buffer, the text of each word, and 64-bit word hashes."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, lower: bool = True):
        joined = b"\n".join(texts)
        self.buffer = (joined.translate(LOWER) if lower else joined) + b"\n"
        data = np.frombuffer(self.buffer, np.uint8)
        inside = is_word[data]
        change = np.flatnonzero(np.diff(inside, prepend=False))
        self.start, self.end = change[::2], change[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.text = np.searchsorted(ends, self.start, side="right")
        self.text_start = ends - [len(t) + 1 for t in texts] if texts else ends
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODES[data] * powers(STEP, len(data)), dtype=np.uint64)])
        self.hash = mixed((running[self.end] - running[self.start]) * powers(INVERSE, len(data) + 1)[self.start]
                          + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of ``size`` words within one text, and their hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(size):
            total = total * STEP + self.hash[j:j + n]
        first = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        return first, mixed(total)[first]

    def joined(self, first: int, size: int) -> bytes:
        return b" ".join(self.buffer[s:e] for s, e in zip(self.start[first:first + size], self.end[first:first + size]))
