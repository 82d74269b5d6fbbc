"""Substring dedup (11): compressed FM-indexes, searched backward for matching statistics (``fm_index.py``).

A window is ``size`` consecutive words (``[^\\x20\\x09-\\x0D]+``, unchanged) of one
document; a word goes if a window covers it whose words also start in a document with
a smaller id. Two rounds, each by an FM-index per shard:

1. a shard is a slice of a task's documents. Its documents are streamed against its
   index; windows that match are settled;
2. a shard is a bucket of *anchors*. A window's anchor is the smallest hash among its
   grams of ``GRAM`` words, so equal windows have equal anchors; neighbouring windows
   with one anchor form a run. Runs of windows not settled, whose anchor several
   documents hold, go to their anchor's bucket, whose index they are streamed against.

Within a shard only stretches all of whose grams a smaller document holds are
streamed, and only text with shared grams is indexed. The first round leaves one
document per shard and window, so a passage of a third of all documents comes to the
second as often as there are shards. Windows at such a passage's edges are different
but share its anchors: an anchor of more than ``HOT`` runs is replaced by the hash of
the whole window, which drops what occurs once, and a window that is still hot is
dealt into parts, each with its smallest document.

Words are compared by 64-bit hashes. Null text has no words. Rows that share a doc_id
are no smaller than each other; a null doc_id is larger than every id. An empty table
gives an empty result. Texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import SLICE_CHARS, arrow_schema, read_table, slices, written
from shelfspark.llm.fm_index import DEPTH, FmIndex, dense
from shelfspark.llm.words import INVERSE, NOT_BLANK, STEP, Words, mixed, powers
from shelfspark.session import scratch_path

WINDOW = 50
GRAM = 8
#: Words of a shard, about.
SHARD_WORDS = 1 << 20
#: Runs of one anchor that go to one bucket.
HOT = 512
#: The id under which rows without one are kept.
LAST_ID = (1 << 63) - 1
SETTLED, RUN = 0, 1
SCAN = "kind int, key long, doc long, t long, start int, count int"
PIECE = "bucket int, doc long, t long, start int, words binary"
WANTED = "key long, part int, doc long, t long, start int, count int"
SPAN = "doc long, t long, start int, count int"


def keyed(docs: DataFrame) -> DataFrame:
    """Ids, texts and a key that tells apart the texts under one id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), text.alias("text"), F.xxhash64(text).alias("t"))


def bucketed(docs: DataFrame) -> DataFrame:
    """``keyed`` documents written in buckets of their keys, so that texts are shuffled once for all later joins with lists of places."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"documents_{uuid.uuid4().hex[:12]}", scratch_path(spark, f"documents-{uuid.uuid4().hex[:12]}")
    (keyed(docs).repartition(buckets, "doc", "t").write.format("parquet").option("path", path).bucketBy(buckets, "doc", "t").sortBy("doc", "t")
     .saveAsTable(name))
    return spark.table(name)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts as hashes, and the number of words of each."""
    hashes, counts, a, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or held and held + len(texts[i]) > SLICE_CHARS:
            if i > a:
                words = Words(texts[a:i], NOT_BLANK, lower=False)
                hashes.append(words.hash)
                counts.append(np.bincount(words.text, minlength=i - a))
            a, held = i, 0
        if i < len(texts):
            held += len(texts[i])
    return np.concatenate(hashes), np.concatenate(counts)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash per place of the ``size`` words from there (across texts, too)."""
    total = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for j in range(size):
        total = total * STEP + hashes[j:j + len(total)]
    return mixed(total)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """A mark per word that begins ``size`` words of one text."""
    n = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(n) + size <= ends


def stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of true marks."""
    edges = np.flatnonzero(np.diff(marks.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def all_of(good: np.ndarray, width: int, n: int) -> np.ndarray:
    """A mark per place of ``n`` from which ``width`` neighbours are all good."""
    bad = np.concatenate([[0], np.cumsum(~good)])
    out = np.zeros(n, bool)
    last = len(good) - width + 1
    if last > 0:
        out[:last] = bad[width:] == bad[:last]
    return out


def repeated_windows(hashes: np.ndarray, counts: np.ndarray, docs: np.ndarray, size: int, gram: int) -> np.ndarray:
    """A mark per word that begins a window which also begins in a text of a smaller document: a shard's index and its stream."""
    n = len(hashes)
    out = np.zeros(n, bool)
    starts = window_starts(counts, size)
    if not starts.any():
        return out
    rank = np.unique(docs, return_inverse=True)[1]
    owner = np.repeat(rank, counts)
    inside = np.flatnonzero(window_starts(counts, gram))
    g = grams(hashes, gram)[inside]
    order = np.argsort(g)
    ordered = g[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
    least = np.minimum.reduceat(owner[inside[order]], first)
    most = np.maximum.reduceat(owner[inside[order]], first)
    good, shared = np.zeros(n, bool), np.zeros(n, bool)
    place = inside[order]
    good[place] = least[group] < owner[place]
    shared[place] = (least < most)[group]
    candidates = all_of(good, size - gram + 1, n) & starts
    if not candidates.any():
        return out
    # What is indexed: the words of windows whose grams are all shared.
    first, end = stretches(all_of(shared, size - gram + 1, n) & starts)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, end + size - 1, -1)
    covered = np.cumsum(cover)[:n] > 0
    covered_from = covered & np.concatenate([[True], ~covered[:-1] | (np.repeat(np.arange(len(counts)), counts)[1:] != np.repeat(np.arange(len(counts)), counts)[:-1])])
    a = np.flatnonzero(covered_from)
    words = np.flatnonzero(covered)
    piece = np.cumsum(covered_from)[words] - 1
    place = np.arange(len(words)) + piece  # a closing 0 behind each piece
    symbols = np.zeros(len(words) + len(a), np.int64)
    symbols[place] = dense(hashes[words]) + 1
    document = np.zeros(len(symbols), np.int64)
    document[place] = owner[words]
    index = FmIndex(symbols, document)
    new_place = np.zeros(n, np.int64)
    new_place[words] = place
    # Streamed: stretches of candidate windows, cut into patterns of at most DEPTH words.
    first, end = stretches(candidates)
    step = DEPTH - size + 1
    parts = -(-(end - first) // step)
    begin = np.repeat(first, parts) + step * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    windows = np.minimum(np.repeat(end, parts) - begin, step)
    marks = index.matches(new_place[begin], new_place[begin] + windows + size - 1, owner[begin], size)
    out[words] = marks[place]
    return out & starts


def settled_and_runs(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Round one: settled windows, and the runs of the others by anchor, both as stretches of window starts."""
    schema = arrow_schema(SCAN)

    def shard(held):
        hashes, counts = np.concatenate([h for h, _, _, _ in held]), np.concatenate([c for _, c, _, _ in held])
        ids, keys = np.concatenate([i for _, _, i, _ in held]), np.concatenate([t for _, _, _, t in held])
        settled = repeated_windows(hashes, counts, ids, size, gram)
        text = np.repeat(np.arange(len(counts)), counts)
        begin = np.cumsum(counts) - counts
        open_ = window_starts(counts, size) & ~settled
        anchor = sliding_least(grams(hashes, gram), size - gram + 1)
        out = []
        new = settled.copy()
        new[1:] &= ~settled[:-1] | (text[1:] != text[:-1])
        out.append((SETTLED, new, settled, None))
        new = open_.copy()
        if len(anchor):
            change = np.ones(len(open_), bool)
            change[1:len(anchor)] = anchor[1:] != anchor[:-1]
            new[1:] &= ~open_[:-1] | (text[1:] != text[:-1]) | change[1:]
        out.append((RUN, new, open_, anchor))
        for kind, new, marks, values in out:
            first = np.flatnonzero(new)
            group = np.cumsum(new)[marks] - 1
            count = np.bincount(group, minlength=len(first))
            owner = text[first]
            columns = (np.full(len(first), kind), values[first].view(np.int64) if values is not None else np.zeros(len(first), np.int64),
                       ids[owner], keys[owner], first - begin[owner], count)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def scan(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch):
                hashes, counts = word_hashes([t.encode() for t in part.column("text").to_pylist()])
                held.append((hashes, counts, part.column("doc").to_numpy(), part.column("t").to_numpy()))
                n += len(hashes)
                if n >= shard_words:
                    yield from shard(held)
                    held, n = [], 0
        if held:
            yield from shard(held)

    return docs.mapInArrow(scan, SCAN)


def shared_windows(docs: DataFrame, runs: DataFrame, size: int, hot: int) -> DataFrame:
    """``(key, part, doc, t, start, count)``: of the ``runs`` of hot anchors the windows that several documents hold, one by one.

    The key is the hash of all words of a window. Hashes cross the shuffle packed by bucket. A window of more
    than ``hot`` places is dealt into parts by document, each with a place in its smallest document."""
    blob_ddl, rows_ddl = "bucket int, keys binary, at binary, starts binary, docs binary, texts binary", WANTED
    blob, rows = arrow_schema(blob_ddl), arrow_schema(rows_ddl)
    windows = runs.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(windows) // SHARD_WORDS)

    def split(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, counts = word_hashes([t.encode() for t in part.column("text").to_pylist()])
                running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(STEP, len(hashes)), dtype=np.uint64)])
                inverse, begin = powers(INVERSE, len(hashes) + 1), np.cumsum(counts) - counts
                at, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, (first, wanted) in enumerate(zip(begin.tolist(), part.column("wanted").to_pylist())):
                    for run in wanted:
                        at.append(np.arange(run["start"], run["start"] + run["count"]) + first)
                        row.append(np.full(run["count"], i))
                at, row = np.concatenate(at), np.concatenate(row)
                key = mixed((running[at + size] - running[at]) * inverse[at])
                bucket = (key >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out, docs_, texts = [[] for _ in blob], part.column("doc").to_numpy(), part.column("t").to_numpy()
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    mine = order[ends[b]:ends[b + 1]]
                    used, local = np.unique(row[mine], return_inverse=True)
                    values = (b, key[mine], local.astype(np.uint32), (at - begin[row])[mine].astype(np.int32), docs_[used], texts[used])
                    for column, value in zip(out, values):
                        column.append(value if isinstance(value, int) else value.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, blob)], schema=blob)

    def share(table: pa.Table) -> pa.Table:
        columns = {c: [np.frombuffer(v, kind) for v in table.column(c).to_pylist()] for c, kind in (
            ("keys", np.uint64), ("at", np.uint32), ("starts", np.int32), ("docs", np.int64), ("texts", np.int64))}
        doc = np.concatenate([d[a] for d, a in zip(columns["docs"], columns["at"])])
        text = np.concatenate([t[a] for t, a in zip(columns["texts"], columns["at"])])
        key, start = np.concatenate(columns["keys"]), np.concatenate(columns["starts"])
        order = np.lexsort((doc, key))
        key, doc, text, start = key[order], doc[order], text[order], start[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size_ = np.diff(np.append(first, len(key)))
        several = doc[first] < doc[first + size_ - 1]                       # sorted: the smallest and the largest document
        parts = -(-size_ // hot)
        group = np.repeat(np.arange(len(first)), size_)
        part = (mixed(doc.view(np.uint64) ^ mixed(text.view(np.uint64))) % parts[group].astype(np.uint64)).astype(np.int64)
        keep = np.flatnonzero(several[group])
        # A copy of the smallest document's place in every part of its window.
        dealt = np.flatnonzero(several & (parts > 1))
        source = np.repeat(first[dealt], parts[dealt])
        source_part = np.arange(len(source)) - np.repeat(np.cumsum(parts[dealt]) - parts[dealt], parts[dealt])
        place, part = np.concatenate([keep, source]), np.concatenate([part[keep], source_part])
        values = (key[place].view(np.int64), part, doc[place], text[place], start[place], np.ones(len(place), np.int64))
        return pa.Table.from_arrays([pa.array(v, pa.int64() if v.dtype != np.int32 else pa.int32()).cast(f.type) for v, f in zip(values, rows)], schema=rows)

    return (with_wanted(docs, runs, "start", "count").mapInArrow(split, blob_ddl)
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(share, rows_ddl))


def with_wanted(docs: DataFrame, runs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the ``columns`` of their runs as a list (of one text, so bounded by it); documents without runs are left out."""
    lists = runs.groupBy("doc", "t").agg(F.collect_set(F.struct(*columns)).alias("wanted"))
    return docs.join(lists.hint("merge"), ["doc", "t"])  # alike at every size: the documents stay in their buckets


def shared_anchors(runs: DataFrame) -> DataFrame:
    """``(key, n)`` of the anchors that several documents hold, and the number of their runs."""
    return (runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
            .where("first < last").select("key", "n"))


def matched(docs: DataFrame, wanted: DataFrame, size: int, gram: int, shard_words: int) -> DataFrame:
    """Round two: of the runs ``wanted(key, part, doc, t, start, count)`` the stretches of matched windows, found in their buckets' indexes."""
    piece_schema, span_schema = arrow_schema(PIECE), arrow_schema(SPAN)
    words = wanted.agg(F.coalesce(F.sum(F.col("count") + size), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(words) // shard_words)
    wanted = wanted.withColumn("bucket", F.pmod(F.xxhash64("key", "part"), F.lit(buckets)).cast("int"))

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, counts = word_hashes([t.encode() for t in part.column("text").to_pylist()])
                begin, out = (np.cumsum(counts) - counts).tolist(), [[] for _ in piece_schema]
                for a, doc, t, wanted in zip(begin, *(part.column(c).to_pylist() for c in ("doc", "t", "wanted"))):
                    for run in wanted:
                        first = a + run["start"]
                        values = (run["bucket"], doc, t, run["start"], hashes[first:first + run["count"] + size - 1].tobytes())
                        for column, value in zip(out, values):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, piece_schema)], schema=piece_schema)

    def stream(table: pa.Table) -> pa.Table:
        raw = table.column("words").to_pylist()
        counts = np.array([len(r) // 8 for r in raw], np.int64)
        marks = repeated_windows(np.frombuffer(b"".join(raw), np.uint64), counts, table.column("doc").to_numpy(), size, gram)
        text = np.repeat(np.arange(len(counts)), counts)
        new = marks.copy()
        new[1:] &= ~marks[:-1] | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        count = np.bincount(np.cumsum(new)[marks] - 1, minlength=len(first))
        owner = text[first]
        start = table.column("start").to_numpy()[owner] + first - (np.cumsum(counts) - counts)[owner]
        columns = (table.column("doc").to_numpy()[owner], table.column("t").to_numpy()[owner], start, count)
        return pa.Table.from_arrays([pa.array(c, pa.int64()).cast(f.type) for c, f in zip(columns, span_schema)], schema=span_schema)

    return (with_wanted(docs, wanted, "bucket", "start", "count").mapInArrow(cut, PIECE)
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(stream, SPAN))


def matched_windows(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(doc, t, start, count)``: stretches of window starts in ``docs(doc, t, text)`` that also start in a smaller document."""
    gram = min(gram, size)
    scan = written(settled_and_runs(docs, size, gram, shard_words), "windows-scanned")
    settled, runs = scan.where(F.col("kind") == SETTLED), scan.where(F.col("kind") == RUN)
    columns = ("key", "doc", "t", "start", "count")
    keys = written(shared_anchors(runs), "anchors-shared")
    wanted = runs.select(*columns).join(keys.where(F.col("n") <= hot).select("key"), "key").withColumn("part", F.lit(0))
    hot_keys = keys.where(F.col("n") > hot).select("key")
    if not hot_keys.isEmpty():
        hot_runs = written(runs.select(*columns).join(hot_keys, "key"), "runs-hot")
        wanted = wanted.unionByName(shared_windows(docs, hot_runs, size, hot))
    wanted = written(wanted.select(*columns, "part"), "runs-wanted")
    found = matched(docs, wanted, size, gram, shard_words)
    return settled.select("doc", "t", "start", "count").unionByName(found)


def without_repeats(docs: DataFrame, size: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, and ``kept``, the other words joined by one space."""
    ddl = "doc_id long, n_words long, n_removed long, kept string"
    schema = arrow_schema(ddl)
    docs = bucketed(docs)
    spans = matched_windows(docs, size, gram, hot, shard_words)
    lists = spans.groupBy("doc", "t").agg(F.collect_set(F.struct("start", "count")).alias("spans"))  # of one text
    joined = docs.join(lists.hint("merge"), ["doc", "t"], "left").select("doc", "text", "spans")

    def remove(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in schema]
                for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                    words = kept = text.encode().split()  # at [\x20\x09-\x0D], as bytes are
                    if spans:
                        edges = np.zeros(len(words) + 1, np.int64)
                        first, count = (np.array([s[c] for s in spans], np.int64) for c in ("start", "count"))
                        np.add.at(edges, first, 1)
                        np.add.at(edges, first + count + size - 1, -1)
                        gone = (np.cumsum(edges)[:-1] > 0).tolist()
                        kept = [w for w, g in zip(words, gone) if not g]
                    for column, value in zip(out, (None if doc == LAST_ID else doc, len(words), len(words) - len(kept), b" ".join(kept).decode())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return joined.mapInArrow(remove, ddl)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_substring_dedup": op11_substring_dedup}
ORACLE = {"op11_substring_dedup": r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)),
hit AS (
  SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY key)),
gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM hit, range(0, 50) AS r(k)),
word AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM doc),
judged AS (
  SELECT w.doc_id, w.pos, w.word, g.pos IS NOT NULL AS removed FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos),
summed AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed), '')) AS kept_sha256
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM doc d LEFT JOIN summed s USING (doc_id)
"""}
