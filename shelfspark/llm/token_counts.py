"""Token counts (8): the whole-token shortcut.

Offline, every vocabulary string that can be a pre-token is run through the
exact merges; those that end as one token are *proved whole*. A document's
pre-tokens that are proved whole count one each without merging; only the rest
is merged, and the lengths found are kept in a bounded table per worker.

Null text is an empty text (0 bytes, 0 tokens). One row is returned per input
row, repeated rows and null ids included; an empty table gives an empty result.
Other columns are not read. Texts of any length are counted whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm.bpe import Bpe, bpe_of, read_spec
from shelfspark.llm.common import map_texts, read_table, tokenizer_path

TOKEN_LIMIT = 2048
#: Lengths of merged words kept per worker before the table starts anew.
KEPT_LENGTHS = 1 << 19
COLUMNS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def proved_whole(bpe: Bpe) -> frozenset[str]:
    """Pre-tokens that the exact merges turn into exactly one token."""
    proved = set()
    for symbols, i in bpe.vocab.items():
        if bpe.suffix and not symbols.endswith(bpe.suffix):
            continue
        try:
            word = bpe.bytes_of.get(i, b"").decode()
        except UnicodeDecodeError:
            continue
        if word and bpe.parts(word) == [word] and bpe.pre_tokens(word) == [word] and bpe.merge(word) == [i]:
            proved.add(word)
    return frozenset(proved)


class Lengths(dict):
    """Tokens per pre-token: one for the proved words, merged on first sight for the rest."""

    def __init__(self, bpe: Bpe, proved: frozenset[str]):
        super().__init__(dict.fromkeys(proved, 1))
        self.bpe, self.proved = bpe, proved

    def __missing__(self, word: str) -> int:
        n = len(self.bpe.merge(word))
        if len(word) <= 64:
            if len(self) > len(self.proved) + KEPT_LENGTHS:
                self.clear()
                self.update(dict.fromkeys(self.proved, 1))
            self[word] = n
        return n


_lengths: dict[int, Lengths] = {}


def lengths_of(spec: str, proved: frozenset[str]) -> Lengths:
    key = hash(spec)
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = Lengths(bpe_of(spec), proved)
    return _lengths[key]


def count(text: str, lengths: Lengths) -> int:
    bpe, n = lengths.bpe, 0
    for part in bpe.parts(text):
        n += 1 if part in bpe.special else sum(map(lengths.__getitem__, bpe.pre_tokens(part)))
    return n


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of every whole text; ``over_limit`` marks those of more than ``limit`` tokens."""
    spec = read_spec(path)
    shared = docs.sparkSession.sparkContext.broadcast((spec, proved_whole(bpe_of(spec))))  # bounded by the vocabulary

    def per_slice(ids, texts):
        lengths = lengths_of(*shared.value)
        texts = [t or "" for t in texts]
        tokens = [count(t, lengths) for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens]}

    return map_texts(docs, per_slice, COLUMNS)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
