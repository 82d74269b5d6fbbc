"""Substring dedup by FM-indexes, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import substring_dedup
from shelfspark.llm.fm_index import FmIndex, SmallestDocument, WaveletTree, suffix_order
from shelfspark.llm.words import mixed
from tests.llm.data import ODD, sha


def test_wavelet_tree_ranks_every_symbol():
    rng = np.random.default_rng(1)
    for n, sigma in ((1, 1), (64, 2), (65, 5), (700, 300)):
        symbols = rng.integers(0, sigma, n)
        tree = WaveletTree(symbols, sigma)
        every = np.arange(sigma)
        base = tree.descend(every, np.zeros(sigma, np.int64))
        for i in {0, 1, n // 2, n}:
            got = tree.descend(every, np.full(sigma, i)) - base
            assert got.tolist() == [int((symbols[:i] == c).sum()) for c in every]


def test_smallest_document_of_every_range():
    rng = np.random.default_rng(2)
    for n in (1, 15, 16, 40, 200):
        docs = rng.integers(0, 50, n)
        a, b = map(np.array, zip(*[(i, j) for i in range(n) for j in range(i + 1, n + 1)]))
        assert SmallestDocument(docs).of(a, b).tolist() == [docs[i:j].min() for i, j in zip(a, b)]


def test_suffix_order_and_backward_steps():
    rng = np.random.default_rng(3)
    for _ in range(30):
        symbols = np.append(rng.integers(1, 4, rng.integers(1, 60)), 0)
        order = suffix_order(symbols, 8)
        keys = [tuple(symbols[i:i + 8]) for i in order]
        assert keys == sorted(keys)
        index, pattern = FmIndex(symbols, np.zeros(len(symbols), np.int64), 8), symbols[:min(5, len(symbols) - 1)]
        first, last = np.array([0]), np.array([len(symbols)])
        for c in pattern[::-1]:
            first, last = index.step(np.array([c]), first, last)
        places = sorted(index_places(symbols, pattern))
        assert sorted(order[first[0]:last[0]].tolist()) == places


def index_places(symbols, pattern):
    k = len(pattern)
    return [i for i in range(len(symbols) - k + 1) if (symbols[i:i + k] == pattern).all()]


def brute_windows(texts, docs, size):
    least = {}
    for t, d in zip(texts, docs):
        for i in range(len(t) - size + 1):
            least[tuple(t[i:i + size])] = min(d, least.get(tuple(t[i:i + size]), d))
    return [i + size <= len(t) and least[tuple(t[i:i + size])] < d for t, d in zip(texts, docs) for i in range(len(t))]


def test_repeated_windows_equal_brute_force():
    rng = np.random.default_rng(4)
    for k in range(150):
        size = int(rng.integers(2, 9))
        gram, letters = int(rng.integers(1, size + 1)), int(rng.choice([1, 2, 3, 30]))
        base = [rng.integers(0, letters, rng.integers(0, 60)).tolist() for _ in range(rng.integers(1, 8))]
        texts = base + [base[0] + base[-1], base[0][3:]] * int(rng.integers(0, 4))
        if k % 30 == 0:
            texts += [list(range(700))] * 3 + [list(range(300))]   # longer than a pattern
        docs = rng.integers(0, 8, len(texts)).tolist()
        hashes = mixed(np.array(sum(texts, []), np.uint64) + np.uint64(1))
        got = substring_dedup.repeated_windows(hashes, np.array([len(t) for t in texts]), np.array(docs), size, gram)
        assert got.tolist() == brute_windows(texts, docs, size)


def words(text):
    return [w for w in re.split("[ \t-\r]+", text or "") if w]


def brute(rows, size):
    """Expected ``(doc_id, n_words, n_removed, kept)``; a null id is larger than every id."""
    last = 1 << 62
    texts, docs = [words(t) for _, t in rows], [last if d is None else d for d, _ in rows]
    marks, out = brute_windows(texts, docs, size), []
    for (doc, _), t in zip(rows, texts):
        mine, marks = marks[:len(t)], marks[len(t):]
        gone = [any(mine[max(0, i - size + 1):i + 1]) for i in range(len(t))]
        kept = " ".join(w for w, g in zip(t, gone) if not g)
        out.append((doc if doc is not None else -1, len(t), sum(gone), kept))
    return sorted(out)


def planted(rng):
    """Copies, near copies, a passage of many documents, order of ids against order of rows, repeated and missing ids."""
    pool = [f"w{i}é" for i in range(400)]
    passage, base = list(rng.choice(pool, 70)), list(rng.choice(pool, 200))
    rows = [(int(i), t) for i, t in enumerate(ODD)]
    for i in range(60):
        body = list(rng.choice(pool, rng.integers(0, 40)))
        rows.append((int(rng.integers(0, 1000)), " ".join(body[:10] + passage + body[10:])))
    for i in range(25):
        copy = list(base)
        copy[int(rng.integers(0, 200))] = "edited"
        rows.append((2000 - i, "\n".join(copy)))
    rows += [(7, " ".join(base)), (7, " ".join(base)), (7, " ".join(passage)), (None, " ".join(base)), (None, " ".join(base + passage)), (None, None)]
    rows += [(5000 + i, "same words " * 200) for i in range(3)] + [(6000, " ".join(pool * 60)), (6001, " ".join(pool * 60) + " end")]
    return rows


@pytest.mark.parametrize("hot, shard_words", [(4096, 1 << 20), (4, 400), (1, 1 << 20)])
def test_documents_equal_brute_force(spark, hot, shard_words):
    rows = planted(np.random.default_rng(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring_dedup.without_repeats(docs, size=12, gram=4, hot=hot, shard_words=shard_words)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute(rows, 12)


def test_edge_cases_of_tables(spark):
    text = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(2, text, "a", 1), (1, text, None, 2), (1, text, "b", 3), (None, None, None, None)],
                                 "doc_id long, text string, t string, n_words int").withColumn("start", F.lit(5))
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed, sha(r.kept)) for r in substring_dedup.without_repeats(docs).collect())
    assert got == [(0, 0, 0, sha("")), (1, 60, 0, sha(text)), (1, 60, 0, sha(text)), (2, 60, 60, sha(""))]
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0
    short = docs.withColumn("text", F.lit("too short for a window"))
    assert {r.n_removed for r in substring_dedup.without_repeats(short).collect()} == {0}
