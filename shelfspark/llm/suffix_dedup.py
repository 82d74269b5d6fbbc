"""Suffix-array dedup (5): maximal repeats by the common-prefix interval tree of enhanced suffix arrays (``repeats.py``).

A window is ``size`` bytes. Every window carries an anchor, the smallest hash
among its grams, so equal windows have equal anchors; neighbouring windows with
one anchor form a run. Runs go by anchor to buckets, as hashes only:

* an anchor of a single run (without its anchor twice inside) repeats nothing;
* a run whose bytes occur several times is a repeat group as a whole;
* the different runs of one anchor are sent, one text of each, to a suffix array.
  A stack scan over its LCP values builds the interval tree, an interval whose
  suffixes differ in their left symbol is a maximal repeat with all its
  occurrences, and each occurrence covers its bytes.

Anchors with more than ``HOT_RUNS`` different runs, or more than ``HOT_BYTES``
bytes of them (runs that repeat inside are long), do not fit one task's suffix
array; their windows are dealt one by one, by hash, counted with map-side
aggregation, and those that occur again are covered.

Null text is an empty text. Rows that share a doc_id are told apart by their
text; equal rows are copies like any others. A null doc_id is kept and counts as
an id of its own. An empty table gives an empty result. Texts of any length are
read whole, matches never cross documents, and strings are judged on the input.
Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, id_and_text, read_table, slices, written
from shelfspark.llm.repeats import Runs, SuffixArray

WINDOW = 200
#: Bytes of different runs that a suffix array takes, about.
BUCKET_BYTES = 1 << 20
#: Different runs of one anchor up to which a suffix array holds them, and their bytes.
HOT_RUNS, HOT_BYTES = 20_000, 4 << 20
#: Windows hashed together, and places whose windows are united to spans together.
HOT_WINDOWS = 1 << 15
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: The id under which rows without one are kept.
NO_ID = -(1 << 63)

BLOB = "bucket int, anchor binary, content binary, at binary, start binary, count binary, inner binary, ids binary, texts binary"
RUN = "doc long, t long, start long, count long, anchor long, text_needed boolean, whole boolean, hot boolean"


def text_key(raw: bytes) -> int:
    """Tells apart the texts under one id."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")


def runs(docs: DataFrame, size: int, buckets: int, hot_runs: int = HOT_RUNS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The runs that matter: parts of repeats as a whole, or those whose text a suffix array must see (not if the anchor is ``hot``)."""
    blob, run = arrow_schema(BLOB), arrow_schema(RUN)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                found = Runs(texts, size)
                if not len(found.text):
                    continue
                ids = np.array(part.column("doc").to_pylist(), np.int64)
                keys = np.array([text_key(t) for t in texts], np.int64)
                bucket = (found.anchor >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [[] for _ in blob]
                for b in np.flatnonzero(np.diff(ends)).tolist():
                    mine = order[ends[b]:ends[b + 1]]
                    used, local = np.unique(found.text[mine], return_inverse=True)
                    values = (b, found.anchor[mine], found.content[mine], local.astype(np.uint32), found.start[mine].astype(np.uint32),
                              found.count[mine].astype(np.uint32), found.inner[mine], ids[used], keys[used])
                    for column, value in zip(out, values):
                        column.append(value if isinstance(value, int) else value.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, blob)], schema=blob)

    def match(table: pa.Table) -> pa.Table:
        columns = {c: [np.frombuffer(v, kind) for v in table.column(c).to_pylist()] for c, kind in (
            ("anchor", np.uint64), ("content", np.uint64), ("at", np.uint32), ("start", np.uint32), ("count", np.uint32),
            ("inner", np.bool_), ("ids", np.int64), ("texts", np.int64))}
        doc = np.concatenate([i[a] for i, a in zip(columns["ids"], columns["at"])])
        key = np.concatenate([i[a] for i, a in zip(columns["texts"], columns["at"])])
        anchor, content, start, count, inner = (np.concatenate(columns[c]) for c in ("anchor", "content", "start", "count", "inner"))
        order = np.lexsort((content, anchor))
        doc, key, anchor, content, start, count, inner = (x[order] for x in (doc, key, anchor, content, start, count, inner))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_text = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
        group, text = np.cumsum(new_anchor) - 1, np.cumsum(new_text) - 1
        whole = np.bincount(text)[text] > 1
        variants = np.bincount(group[new_text])[group]
        needed = new_text & ((variants > 1) | inner)
        keep = whole | needed
        held = np.bincount(group, (count + np.float64(size)) * needed)[group]
        values = (doc, key, start, count, anchor.view(np.int64), needed, whole, (variants > hot_runs) | (held > hot_bytes))
        return pa.Table.from_arrays([pa.array(v[keep].astype(bool if f.type == pa.bool_() else np.int64)) for v, f in zip(values, run)], schema=run)

    return (keyed(docs).mapInArrow(scan, BLOB).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(match, RUN))


TEXT = "bucket int, doc long, t long, start long, count long, bytes binary"
SPAN = "doc long, t long, a long, b long"


def run_texts(docs: DataFrame, wanted: DataFrame, size: int, buckets: int) -> DataFrame:
    """The bytes of the runs ``wanted``, with the bucket of their anchor."""
    schema = arrow_schema(TEXT)

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in schema]
                for doc, text, wanted in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "wanted"))):
                    raw = (text or "").encode()
                    key = text_key(raw)
                    for run in wanted:
                        if run["t"] == key:
                            data = raw[run["start"]:run["start"] + run["count"] - 1 + size]
                            for column, value in zip(out, (run["bucket"], doc, key, run["start"], run["count"], data)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).cast("int").alias("bucket")
    per_id = wanted.groupBy("doc").agg(F.collect_list(F.struct("t", "start", "count", bucket)).alias("wanted"))  # the runs of one id
    return keyed(docs).join(per_id, "doc").mapInArrow(cut, TEXT)


def repeat_spans(docs: DataFrame, size: int = WINDOW, hot_runs: int = HOT_RUNS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``(doc, t, a, b)``: byte spans, not yet united, that windows occurring elsewhere cover; doc is the id, t the text's key."""
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = id_and_text(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = written(runs(docs, size, max(shuffle, int(total) * 28 // 77 >> 25), hot_runs, hot_bytes), "repeat-runs")
    whole = found.where("whole").select("doc", "t", F.col("start").alias("a"), (F.col("start") + F.col("count") + (size - 1)).alias("b"))
    wanted = found.where("text_needed")
    size_needed, any_hot = wanted.agg(F.coalesce(F.sum(F.col("count") + size), F.lit(0)), F.coalesce(F.max("hot"), F.lit(False))).first()
    buckets = max(shuffle, int(size_needed) // BUCKET_BYTES)
    span = arrow_schema(SPAN)

    def by_suffix_array(table: pa.Table) -> pa.Table:
        doc, t, start = (table.column(c).to_numpy() for c in ("doc", "t", "start"))
        array = SuffixArray(table.column("bytes").to_pylist(), table.column("count").to_numpy())
        marks = array.covered(size)
        edges = np.flatnonzero(np.diff(marks, prepend=False, append=False))
        a, b = edges[::2], edges[1::2]
        string = np.searchsorted(array.begin, a, side="right") - 1
        shift = start[string] - array.begin[string]
        columns = (doc[string], t[string], a + shift, b + shift)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=span)

    spans = whole.unionAll(run_texts(docs, wanted.where("not hot"), size, buckets).groupBy("bucket").applyInArrow(by_suffix_array, SPAN))
    if any_hot:
        spans = spans.unionAll(hot_spans(run_texts(docs, wanted.where("hot"), size, buckets), size))
    return spans


def hot_spans(texts: DataFrame, size: int) -> DataFrame:
    """Spans of the windows that occur more than once among the runs ``texts`` (anchors too frequent or too long for one suffix array)."""
    ddl = "w1 long, w2 long, doc long, t long, at long"
    schema, span = arrow_schema(ddl), arrow_schema(SPAN)

    def windows(batches):
        for batch in batches:
            for doc, t, start, count, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "start", "count", "bytes"))):
                for first in range(0, count, HOT_WINDOWS):
                    at = np.arange(first, min(count, first + HOT_WINDOWS))
                    keys = b"".join(hashlib.blake2b(data[i:i + size], digest_size=16).digest() for i in at.tolist())
                    w = np.frombuffer(keys, np.int64).reshape(-1, 2)
                    columns = (np.ascontiguousarray(w[:, 0]), np.ascontiguousarray(w[:, 1]), np.full(len(at), doc), np.full(len(at), t), at + start)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    def united(batches):
        for batch in batches:
            for doc, t, at in zip(*(batch.column(c) for c in ("doc", "t", "at"))):
                at = np.sort(at.values.to_numpy())
                new = np.diff(at, prepend=at[0] - size - 1) > size
                a, b = at[new], at[np.append(new[1:], True)] + size
                columns = (np.full(len(a), doc.as_py()), np.full(len(a), t.as_py()), a, b)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=span)

    found = texts.mapInArrow(windows, ddl)
    again = found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    part = F.floor(F.col("at") / HOT_WINDOWS).alias("part")
    return found.join(again, ["w1", "w2"]).groupBy("doc", "t", part).agg(F.collect_list("at").alias("at")).mapInArrow(united, SPAN)


def without_repeats(docs: DataFrame, size: int = WINDOW, hot_runs: int = HOT_RUNS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``(doc_id, text, kept binary, n_removed, n_spans)``: each document's bytes without the repeated ones."""
    ddl = "doc_id long, text string, kept binary, n_removed long, n_spans long"
    schema = arrow_schema(ddl)
    per_text = repeat_spans(docs, size, hot_runs, hot_bytes).groupBy("doc").agg(F.collect_list(F.struct("t", "a", "b")).alias("spans"))  # of one id
    parts = F.struct(F.col("spans.t").alias("t"), F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))
    joined = keyed(docs).join(per_text.select("doc", parts.alias("s")), "doc", "left").select("doc", "text", "s.t", "s.a", "s.b")

    def remove(batches):
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in schema]
                for doc, text, t, a, b in zip(*(part.column(c) for c in ("doc", "text", "t", "a", "b"))):
                    doc, text = doc.as_py(), text.as_py()
                    raw = (text or "").encode()
                    kept, removed, n = raw, 0, 0
                    if t.is_valid and len(t):
                        mine = t.values.to_numpy() == text_key(raw)
                        edges = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(edges, a.values.to_numpy()[mine], 1)
                        np.add.at(edges, b.values.to_numpy()[mine], -1)
                        gone = np.cumsum(edges)[:-1] > 0
                        removed, n = int(gone.sum()), int((np.diff(gone, prepend=False) & gone).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    for column, value in zip(out, (None if doc == NO_ID else doc, text, kept, removed, n)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return joined.mapInArrow(remove, ddl)


def repeat_report(docs: DataFrame, size: int = WINDOW, hot_runs: int = HOT_RUNS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Per document its bytes, the removed bytes and spans, and the hash of what is left."""
    return without_repeats(docs, size, hot_runs, hot_bytes).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLE: dict[str, str] = {}
