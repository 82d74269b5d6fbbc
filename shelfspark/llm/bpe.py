"""Exact byte-pair encoding as a tokenizer file describes it: splitting into pre-tokens and merging.

``Bpe`` is built from the JSON text of a tokenizer file (vocabulary, ordered
merges, word-end suffix, special strings). It is small and is rebuilt from a
broadcast string once per worker. Texts within Latin-1 are split by the plain
patterns below; any other text is normalised and split by the tokenizers
library, so that both follow the same Unicode tables.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import cached_property, lru_cache

#: White space, letters and numbers of Latin-1 (fixed by Unicode).
SPACE = "\\t-\\r \x85\xa0"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
BEYOND_LATIN = re.compile("[^\x00-\xff]")
BYTE_LEVEL = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
NEVER = 1 << 60
BITS = 17
MASK = (1 << BITS) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in plain}
    for b in range(256):
        names.setdefault(b, chr(256 + len(names) - len(plain)))
    return [names[b] for b in range(256)]


class Bpe:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, text: str):
        self.text = text
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.lowered = spec.get("normalizer") is not None
        self.symbols = byte_symbols()
        self.first = [self.vocab.get(c) for c in self.symbols]
        self.last = [self.vocab.get(c + self.suffix) for c in self.symbols]
        #: pair of ids -> rank and joined id, both packed into integers so that the smallest value is the next merge
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a] << BITS | self.vocab[b]] = rank << BITS | self.vocab[a + b]
        of = {c: b for b, c in enumerate(self.symbols)}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(of[c] for c in s.removesuffix(self.suffix)) for s, i in self.vocab.items() if s not in self.special}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own."""
        if self.split_special is None or not any(s in text for s in self.special):
            return [text]
        return [p for p in self.split_special.split(text) if p]

    def pre_tokens(self, part: str) -> list[str]:
        """Pre-tokens of a part that is no special string."""
        if BEYOND_LATIN.search(part):
            if self.lowered:
                part = self.library.normalizer.normalize_str(part)
            return [part[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return WORD_LEVEL.findall(part.lower()) if self.lowered else BYTE_LEVEL.findall(part)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, is joined until none is left."""
        raw = word.encode()
        first = self.first
        ids = [first[b] for b in raw]
        if self.suffix:
            ids[-1] = self.last[raw[-1]]
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        ranks = [get(a << BITS | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            i = ranks.index(best)
            ids[i] = new = best & MASK
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << BITS | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << BITS | new, NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order with a heap and linked positions, for words of any length."""
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := get(ids[i] << BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or get(ids[i] << BITS | ids[j]) != m:
                continue
            ids[i], ids[j] = (new := m & MASK), None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := get(new << BITS | ids[k])) is not None:
                    heapq.heappush(heap, (m, i))
            if (h := before[i]) >= 0 and (m := get(ids[h] << BITS | new)) is not None:
                heapq.heappush(heap, (m, h))
        return [x for x in ids if x is not None]


@lru_cache(maxsize=4)
def bpe_of(text: str) -> Bpe:
    """One ``Bpe`` per worker process and tokenizer text."""
    return Bpe(text)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
