"""Language ID (1): a bidirectional gated recurrent network over bytes (``gru.py``).

Trained here by backpropagation through time on a bounded sample: about
``SAMPLE_DOCS`` labelled documents that are not held out (by a hash of the whole row,
in its order), at most ``SAMPLE_SEGMENTS`` segments of each. Held out are documents whose
crc32(doc_id as text) mod 4 is 2. Prediction labels every byte position of the
whole text and averages the probabilities; ``lang``, ``source`` and ``doc_id``
are no inputs.

A null text, or one without a letter, is ``und`` with score 0, as is every text
when no labelled document is left to learn from. A null doc_id is not held out.
One row is returned per input row, repeated rows included; an empty table gives
an empty result. Ties go to the label that sorts first. Other columns are not
read by ``languages`` and pass through ``with_known_language``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, map_texts, read_table, slices
from shelfspark.llm.gru import SEGMENT, ByteGru, cut

#: Bounds of the training sample.
SAMPLE_DOCS = 4000
SAMPLE_SEGMENTS = 3
UNKNOWN = "und"
#: Documents whose best label is less probable than this are rejected by ``with_known_language``.
MIN_SCORE = 0.35
COLUMNS = "doc_id long, held_out boolean, lang_pred string, score double"
LETTER = re.compile(r"[^\W\d_]")


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def spread(text: str, n: int = SAMPLE_SEGMENTS) -> list[bytes]:
    """At most ``n`` segments of a text, evenly spaced: what training sees of it."""
    raw = text.encode()
    count = -(-len(raw) // SEGMENT)
    return [raw[k * SEGMENT:(k + 1) * SEGMENT] for k in sorted({i * (count - 1) // max(1, n - 1) for i in range(n)})] if raw else []


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, **how) -> ByteGru | None:
    """The network, or None without labelled documents."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    n = labelled.select("lang").count()
    by = F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(max(1, n)))  # alike rows share a place, and are alike
    sample = labelled.where(by < sample_docs).orderBy(by, "doc_id", "lang").limit(2 * sample_docs)
    schema = arrow_schema("lang string, segment binary")

    def segments(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(lang, s) for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist())
                        if has_letter(text) for s in spread(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    rows = sorted((r.lang, bytes(r.segment)) for r in sample.mapInArrow(segments, "lang string, segment binary").collect())
    if not rows:
        return None
    labels = sorted({lang for lang, _ in rows})
    x, valid, _ = cut([s for _, s in rows])
    return ByteGru(labels).fit(x, valid, np.array([labels.index(lang) for lang, _ in rows]), **how)


def predict(texts: list[str | None], model: ByteGru | None) -> list[tuple[str, float]]:
    """``(label, pooled probability)`` of each whole text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if model and has_letter(t)]
    if known:
        p = model.pooled([texts[i].encode() for i in known])
        for i, best, score in zip(known, p.argmax(1).tolist(), p.max(1).tolist()):
            out[i] = model.labels[best], min(1.0, score)
    return out


def languages(docs: DataFrame, model: ByteGru | None = None) -> DataFrame:
    """The predicted language of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))  # a few thousand parameters

    def per_slice(ids, texts):
        found = predict(texts, shared.value)
        return {"doc_id": ids, "held_out": [is_held_out(i) for i in ids], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_texts(docs, per_slice, COLUMNS)


def with_known_language(docs: DataFrame, model: ByteGru | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents whose language is ``und`` or less probable than ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                found = predict(part.column("text").to_pylist(), shared.value)
                yield part.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in found], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE: dict[str, str] = {}
