"""Benchmark decontamination (4): a broadcast hash set of normalised test n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A
window is ``size`` consecutive words of an item; an item of fewer words is one
window. Tasks hash the word windows of whole texts, look them up in the hash
set, verify each hit word by word, and mark the words that any window covers.

The windows of the benchmark are broadcast only up to ``BLOCK_BYTES`` of item
text; a larger benchmark is split by hash into blocks of that size, and one
pass over the documents per block adds to the marks of the pass before (each
pass is written to the shared folder).

Null text has no words (0 words, not contaminated); null items have no
windows, and hits of an item without id mark words but list no item. One row is
returned per input row, repeated rows and null ids included; repeated items
count once per id. Empty tables give an empty result, or no hits. Texts of any
length are scanned whole; other columns pass through ``decontaminate`` as they are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, id_and_text, read_table, slices, written
from shelfspark.llm.words import ALPHANUMERIC, Words

WINDOW = 10
#: Text of benchmark items whose windows are broadcast at a time: some 50 MB of arrays.
BLOCK_BYTES = 8 << 20
COLUMNS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

class TestWindows:
    """The hash set: per window length the sorted hashes, each with its item and first word, and the items' words for verification.

    Arrays only: a window takes 16 bytes, a word 8 and its text."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        words = Words([(t or "").encode() for _, t in items], ALPHANUMERIC)
        count = np.bincount(words.text, minlength=len(items)) if items else np.zeros(0, np.int64)
        self.ids = [i for i, _ in items]
        self.buffer, self.start, self.end = words.buffer, words.start.astype(np.int32), words.end.astype(np.int32)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({min(size, int(n)) for n in np.unique(count) if n}):
            first, hashes = words.windows(length)
            item = words.text[first]
            real = (count[item] == length) | (length == size)  # of a shorter item the whole, of others the full windows
            first, hashes, item = first[real], hashes[real], item[real]
            order = np.argsort(hashes, kind="stable")
            self.sorted[length] = hashes[order], first[order].astype(np.int32), item[order].astype(np.int32)

    def items_of(self, size: int, at: int, window: bytes) -> set | None:
        """The items that hold exactly ``window``, among the entries with the hash of entry ``at``; None if none does."""
        hashes, first, item = self.sorted[size]
        last = int(np.searchsorted(hashes, hashes[at], side="right"))
        who = set()
        for f, i in zip(first[at:last].tolist(), item[at:last].tolist()):
            if b" ".join(self.buffer[s:e] for s, e in zip(self.start[f:f + size].tolist(), self.end[f:f + size].tolist())) == window:
                who.add(self.ids[i])
        return who or None

    def scan(self, texts: list[bytes]) -> tuple[Words, np.ndarray, list[set]]:
        """Words of the texts, a mark per word that some window covers, and the items found per text."""
        words = Words(texts, ALPHANUMERIC)
        marks = np.zeros(len(words.hash) + 1, np.int32)
        items: list[set] = [set() for _ in texts]
        for size, (hashes, _, _) in self.sorted.items():
            first, found = words.windows(size)
            if not len(first):
                continue
            at = np.searchsorted(hashes, found)
            hit = at < len(hashes)
            hit[hit] = hashes[at[hit]] == found[hit]
            known: dict[bytes, set | None] = {}
            for i, a in zip(first[hit].tolist(), at[hit].tolist()):
                window = words.joined(i, size)
                if window not in known:
                    known[window] = self.items_of(size, a, window)
                who = known[window]
                if who is not None:  # the hash was no coincidence
                    marks[i] += 1
                    marks[i + size] -= 1
                    items[words.text[i]] |= who
        return words, np.cumsum(marks[:-1]) > 0, items


def blocks(benchmark: DataFrame, size: int, block_bytes: int) -> list:
    """Broadcast hash sets, each of the windows of at most about ``block_bytes`` of item text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = 1 + int(total) // block_bytes
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(TestWindows([tuple(r) for r in part.collect()], size))


MARKED = "doc_id long, text string, n_words long, n_hit long, hit binary, items array<string>"


def marked(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text, n_words, n_hit, hit, items)``: a byte per word that is 1 where a window covers it, and the items found."""
    schema = arrow_schema(MARKED)
    out = id_and_text(docs).withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit": F.lit(None).cast("binary"),
                                         "items": F.array().cast("array<string>")})
    for k, block in enumerate(blocks(benchmark, size, block_bytes)):
        if k:
            out = written(out, "decontamination-pass")

        def scan(batches, block=block):
            for batch in batches:
                for part in slices(batch):
                    rows = part.to_pydict()
                    words, covered, items = block.value.scan([(t or "").encode() for t in rows["text"]])
                    count = np.bincount(words.text, minlength=len(items))
                    hits = [c.astype(np.uint8) for c in np.split(covered, np.cumsum(count)[:-1])] if len(items) else []
                    for j, before in enumerate(rows["hit"]):
                        if before is not None:
                            hits[j] |= np.frombuffer(before, np.uint8)
                        items[j] = sorted(items[j] - {None} | set(rows["items"][j]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("text").cast(pa.string()), pa.array(count, pa.int64()),
                         pa.array([int(h.sum()) for h in hits], pa.int64()), pa.array([h.tobytes() for h in hits], pa.binary()), pa.array(items, pa.list_(pa.string()))], schema=schema)

        out = out.mapInArrow(scan, MARKED)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, hit words, items whose windows occur, and whether there are any."""
    return marked(docs, benchmark, size, block_bytes).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, remove: str = "documents", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with all columns, without contaminated documents, or with the covered spans cut out of ``text``.

    Spans are marked by every block on the unchanged text and cut once at the end."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    out, hit = docs, "hit"
    while hit in map(str.lower, docs.columns):
        hit = f"_{hit}"
    if remove == "spans":
        out = docs.withColumn(hit, F.lit(None).cast("binary"))
    step = _dropping if remove == "documents" else _marking
    for k, block in enumerate(blocks(benchmark, size, block_bytes)):
        if k:
            out = written(out, "decontamination-pass")
        out = out.mapInArrow(step(block, arrow_schema(out.schema), hit), out.schema)
    return out if remove == "documents" else out.mapInArrow(_cutting(arrow_schema(docs.schema), hit), docs.schema)


def _dropping(block, schema: pa.Schema, hit: str):
    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                words, covered, _ = block.value.scan([(t or "").encode() for t in texts])
                bad = np.bincount(words.text[covered], minlength=len(texts)) > 0
                yield part.filter(pa.array(~bad))

    return scan


def _marking(block, schema: pa.Schema, hit: str):
    """Adds the words that the block covers to the marks in column ``hit``, a byte per word."""
    at = schema.get_field_index(hit)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                words, covered, _ = block.value.scan([(t or "").encode() for t in texts])
                count = np.bincount(words.text, minlength=len(texts))
                hits = [c.astype(np.uint8) for c in np.split(covered, np.cumsum(count)[:-1])]
                for new, before in zip(hits, part.column(at).to_pylist()):
                    if before is not None:
                        new |= np.frombuffer(before, np.uint8)
                yield part.set_column(at, schema.field(at), pa.array([h.tobytes() for h in hits], pa.binary()))

    return scan


def _cutting(schema: pa.Schema, hit: str):
    """Cuts the runs of marked words out of the texts; the marks themselves go."""
    at = schema.get_field_index("text")

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                words = Words([(t or "").encode() for t in texts], ALPHANUMERIC)
                covered = np.frombuffer(b"".join(part.column(hit).to_pylist()), np.uint8) > 0
                edges = np.flatnonzero(np.diff(covered, prepend=False, append=False))
                spans = defaultdict(list)
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    while a < b:  # a run of covered words may go on in the next text
                        t = int(words.text[a])
                        last = min(b, int(np.searchsorted(words.text, t, side="right")))
                        spans[t].append((words.start[a] - words.text_start[t], words.end[last - 1] - words.text_start[t]))
                        a = last
                for t, cut in spans.items():
                    raw, kept, done = texts[t].encode(), [], 0
                    for a, b in cut:
                        kept.append(raw[done:a])
                        done = b
                    texts[t] = (b"".join(kept) + raw[done:]).decode()
                part = part.drop_columns([hit])
                yield part.set_column(at, schema.field(at), pa.array(texts, schema.field(at).type))

    return scan


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE = {"op4_decontamination": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM item WHERE len(w) > 0),
test AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM test),
found AS (
  SELECT d.doc_id, d.i, d.n, t.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lengths WHERE len(w) >= n)) d
  JOIN test t ON t.n = d.n AND t.gram = d.gram),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""}
