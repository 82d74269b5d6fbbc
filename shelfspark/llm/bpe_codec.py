"""BPE encoding and decoding (7): a minimal acyclic transducer as lexicon.

All documents' pre-tokens are counted on Spark; the most frequent ones (a
bounded lexicon, ``LEXICON_WORDS``) are compiled into a minimal acyclic
automaton that shares prefixes and suffixes. Each edge carries the number of
lexicon words that sort before it, so the sum along a path is the word's
number, which points to the ids. The automaton is broadcast as one byte string
and memory-mapped by the workers. A word outside the lexicon is merged exactly.
The lexicon changes speed, never ids.

Null text is an empty text. One row is returned per input row, repeated rows
and null ids included; an empty table gives an empty result (and an empty
lexicon). Other columns are not read. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import io
import mmap
import tempfile
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.bpe import Bpe, bpe_of, read_spec
from shelfspark.llm.common import arrow_schema, id_and_text, map_texts, most_frequent, read_table, slices, tokenizer_path, written

#: Words in the lexicon (a few MB of automaton); the rest is merged.
LEXICON_WORDS = 1 << 16
#: Distinct words a counting task, or a worker's table of results, holds before it is emptied.
HELD_WORDS = 1 << 18
COLUMNS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Transducer:
    """A minimal acyclic automaton over bytes, as flat arrays: edges sorted by (state, byte)."""

    def __init__(self, keys, targets, counts, final, starts, ids):
        self.keys, self.targets, self.counts, self.final, self.starts, self.ids = keys, targets, counts, final, starts, ids

    @classmethod
    def compile(cls, words: dict[bytes, list[int]]) -> Transducer:
        """Incremental construction from sorted words; a finished state equal to an older one is replaced by it."""
        edges: list[dict[int, int]] = [{}]
        final = [False]
        registry: dict[tuple, int] = {}

        def settle(path: list[tuple[int, int, int]], keep: int) -> None:
            while len(path) > keep:
                parent, byte, state = path.pop()
                signature = (final[state], tuple(edges[state].items()))
                edges[parent][byte] = registry.setdefault(signature, state)

        path: list[tuple[int, int, int]] = []
        previous = b""
        ordered = sorted(words)
        for word in ordered:
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            settle(path, common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                edges.append({})
                final.append(False)
                edges[state][byte] = len(edges) - 1
                path.append((state, byte, len(edges) - 1))
                state = len(edges) - 1
            final[state] = True
            previous = word
        settle(path, 0)

        below: dict[int, int] = {}
        order, stack = [], [0]
        seen = {0}
        while stack:  # states in an order where parents come first
            state = stack.pop()
            order.append(state)
            for target in edges[state].values():
                if target not in seen:
                    seen.add(target)
                    stack.append(target)

        def words_from(root: int) -> None:
            todo = [(root, False)]
            while todo:
                state, done = todo.pop()
                if state in below:
                    continue
                if done:
                    below[state] = final[state] + sum(below[t] for t in edges[state].values())
                else:
                    todo.append((state, True))
                    todo.extend((t, False) for t in edges[state].values() if t not in below)

        words_from(0)
        number = {state: i for i, state in enumerate(order)}
        rows = []
        for state in order:
            passed = int(final[state])
            for byte, target in sorted(edges[state].items()):
                rows.append((number[state] << 8 | byte, number[target], passed))
                passed += below[target]
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
        lengths = [len(words[w]) for w in ordered]
        return cls(table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32),
                   np.array([final[s] for s in order], dtype=np.bool_), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
                   np.array(list(chain.from_iterable(words[w] for w in ordered)), dtype=np.int32))

    ARRAYS = ("keys", "targets", "counts", "final", "starts", "ids")

    def dump(self) -> bytes:
        """All arrays behind each other in NumPy's own format."""
        out = io.BytesIO()
        for name in self.ARRAYS:
            np.save(out, getattr(self, name))
        return out.getvalue()

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """The arrays as views of a memory map over an unnamed file, shared by forked workers and gone with them."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        arrays, at = [], 0
        for _ in cls.ARRAYS:
            head = io.BytesIO(held[at:at + 4096])
            np.lib.format.read_magic(head)
            shape, _, kind = np.lib.format.read_array_header_1_0(head)
            at += head.tell()
            arrays.append(np.frombuffer(held, kind, shape[0], at))
            at += arrays[-1].nbytes
        return cls(*arrays)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, -1 for a word outside it; all words take a step together."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.starts) or not len(words) or not len(self.final):
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        alive = np.arange(len(words))
        state, passed = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = size[alive] == step
            done = alive[ended]
            out[done] = np.where(self.final[state[done]], passed[done], -1)
            alive = alive[~ended]
            if not len(alive) or not len(self.keys):
                break
            key = state[alive] << 8 | data[start[alive] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[edge] == key
            alive, edge = alive[found], edge[found]
            state[alive] = self.targets[edge]
            passed[alive] += self.counts[edge]
            step += 1
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.starts[number]:self.starts[number + 1]].tolist()


def word_counts(docs: DataFrame, spec: str) -> DataFrame:
    """Pre-tokens of all whole texts with their counts; tasks count first, so a frequent word crosses the shuffle once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = arrow_schema("word binary, n long")

    def scan(batches):
        bpe, held = bpe_of(shared.value), Counter()

        def out():
            words = pa.array([w.encode() for w in held], pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    for piece in bpe.parts(text or ""):
                        if piece not in bpe.special:
                            held.update(bpe.pre_tokens(piece))
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    return id_and_text(docs).mapInArrow(scan, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, spec: str, size: int = LEXICON_WORDS) -> bytes:
    """The compiled automaton of the most frequent pre-tokens seen more than once, at most ``size``."""
    bpe = bpe_of(spec)
    counts = written(word_counts(docs, spec).where((F.col("n") > 1) & (F.length("word") <= 64)), "word-counts")
    frequent = most_frequent(counts, size).select("word").collect()  # at most ``size`` words
    return Transducer.compile({bytes(r[0]): bpe.merge(bytes(r[0]).decode()) for r in frequent}).dump()


class Encoder:
    """Words to ids through the automaton, or by merging; recent words stay in a bounded table."""

    def __init__(self, spec: str, automaton: bytes):
        self.bpe = bpe_of(spec)
        self.lexicon = Transducer.mapped(automaton)
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > HELD_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for word, number in zip(new, self.lexicon.numbers([w.encode() for w in new]).tolist()):
            self.known[word] = tuple(self.lexicon.output(number) if number >= 0 else self.bpe.merge(word))

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text; special strings become their own ids, as in the library."""
        special = self.bpe.special
        cut = [[(p,) if p in special else self.bpe.pre_tokens(p) for p in self.bpe.parts(t)] for t in texts]
        self.learn({w for parts in cut for p in parts if type(p) is list for w in p})
        known, out = self.known, []
        for parts in cut:
            ids: list[int] = []
            for p in parts:
                if type(p) is tuple:
                    ids.append(special[p[0]])
                else:
                    ids.extend(chain.from_iterable(map(known.__getitem__, p)))
            out.append(ids)
        return out


def decode(bpe: Bpe, ids: list[int]) -> str:
    """The text of the ids: their bytes joined, broken UTF-8 replaced."""
    return b"".join(map(bpe.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoder: dict[int, Encoder] = {}


def encoder_of(spec: str, automaton: bytes) -> Encoder:
    """One encoder per worker process."""
    key = hash((spec, automaton))
    if key not in _encoder:
        _encoder.clear()
        _encoder[key] = Encoder(spec, automaton)
    return _encoder[key]


def shared_encoder(docs: DataFrame, path: str, size: int = LEXICON_WORDS):
    """A broadcast (tokenizer text, automaton): both bounded, by the vocabulary and by the lexicon's size."""
    spec = read_spec(path)
    return docs.sparkSession.sparkContext.broadcast((spec, lexicon(docs, spec, size)))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> DataFrame:
    """Per document the number of ids and the hashes of the ids and of the text decoded from them."""
    shared = shared_encoder(docs, path, size)

    def per_slice(doc_ids, texts):
        encoder = encoder_of(*shared.value)
        ids = encoder.ids([t or "" for t in texts])
        name = [str(i) for i in range(1 + max((max(x, default=0) for x in ids), default=0))]
        return {"doc_id": doc_ids, "n_tokens": [len(x) for x in ids],
                "ids_sha256": [sha(",".join(map(name.__getitem__, x))) for x in ids],
                "decoded_sha256": [sha(decode(encoder.bpe, x)) for x in ids]}

    return map_texts(docs, per_slice, COLUMNS)


def encoded(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text."""
    shared = shared_encoder(docs, path, size)

    def per_slice(doc_ids, texts):
        return {"doc_id": doc_ids, "ids": encoder_of(*shared.value).ids([t or "" for t in texts])}

    return map_texts(docs, per_slice, "doc_id long, ids array<int>")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op7_bpe_codec": op7_bpe_codec}
ORACLE: dict[str, str] = {}
