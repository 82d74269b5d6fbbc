"""Line dedup (3): levelled sorted runs of line hashes.

Documents arrive in batches of ascending ``doc_id``. A *run* is a table of
128-bit line-key hashes, bucketed and sorted by hash. Each batch is reduced to
one row per key, merge-joined with the runs (semi: the key was seen in an
earlier batch, so all its lines here go; anti: the key is new) and its new keys
become a run of level 0. When a level holds ``FANOUT`` runs they are compacted
into one run of the next level. Bucketed runs are read by the merge join
without another shuffle.

A line's key is the line without leading and trailing ``[\\x20\\x09-\\x0D]``,
A-Z lower-cased. Keys of fewer than ``MIN_CHARS`` code points are never dropped.
Null or empty text is one empty line. Rows that share a doc_id are told apart by their
texts and judged as one document's rows: a key keeps its lines in all rows of its
smallest id. A null doc_id sorts behind every id; rows without one share that place.
Empty tables give an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, read_table, slices, written
from shelfspark.session import Scratch

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
#: The id under which rows without one are kept.
LAST_ID = (1 << 63) - 1
BLANKS = " \t\n\x0b\x0c\r"
COLUMNS = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def owner_id() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def text_key() -> F.Column:
    """Tells apart the texts under one id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def line_key(line: str) -> bytes:
    """What makes two lines the same: blanks stripped at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).encode().lower()  # bytes.lower() touches A-Z only


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, doc, t, pos)`` of every line whose key is long enough: the key's 128-bit hash, the owner and its text, the line's number."""
    ddl = "h1 long, h2 long, doc long, t long, pos int"
    schema = arrow_schema(ddl)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                doc, key, pos, hashes = [], [], [], []
                for owner, text, t in zip(*(part.column(c).to_pylist() for c in ("doc", "text", "t"))):
                    for i, line in enumerate((text or "").split("\n")):
                        if len(line) >= min_chars and len(line.strip(BLANKS)) >= min_chars:
                            doc.append(owner)
                            key.append(t)
                            pos.append(i)
                            hashes.append(hashlib.blake2b(line_key(line), digest_size=16).digest())
                h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])),
                                                  pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(pos, pa.int32())], schema=schema)

    return docs.select(owner_id().alias("doc"), F.col("text").cast("string").alias("text"), text_key().alias("t")).mapInArrow(scan, ddl)


class LineRuns:
    """The levelled runs of one corpus. ``add`` takes the next batch and returns what its documents lose."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.scratch = Scratch(spark)

    def _run(self, keys: DataFrame) -> str:
        """A run: one file per bucket, sorted by hash."""
        return self.scratch.keep(keys, self.buckets, ("h1", "h2"))

    def add(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        """``(doc, t, dropped array<int>)``: line numbers that the batch's texts lose, written to the shared folder."""
        lines = line_keys(docs, min_chars)
        batch = self._run(lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
        keys, runs = self.spark.table(batch), [self.spark.table(r) for level in self.levels for r in level]
        # Keys of earlier batches lose all their lines (no first owner here), new ones all but the first owner's.
        new, losing = keys, None
        for run in runs:
            old = keys.join(run.hint("merge"), ["h1", "h2"], "left_semi").select("h1", "h2", F.lit(None).cast("long").alias("first"))
            losing = old if losing is None else losing.unionAll(old)
            new = new.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        repeated = new.where("first < last").select("h1", "h2", "first")
        losing = repeated if losing is None else losing.unionAll(repeated)
        lost = lines.join(losing.hint("merge"), ["h1", "h2"]).where("first IS NULL OR doc > first")
        lost = written(lost.groupBy("doc", "t").agg(F.collect_set("pos").alias("dropped")), "lines-lost")  # of one text
        self._store(self._run(new.select("h1", "h2")))
        self.scratch.drop(batch)
        return lost

    def _store(self, name: str) -> None:
        """The run goes to level 0; a full level is compacted into one run of the next."""
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            merged = None
            for run in self.levels[level]:
                t = self.spark.table(run)
                merged = t if merged is None else merged.unionAll(t)
            name = self._run(merged.repartition(self.buckets, "h1", "h2"))
            for run in self.levels[level]:
                self.scratch.drop(run)
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        """Deletes the runs."""
        self.scratch.close()
        self.levels = []


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` ranges of ascending id with about as many documents each; equal ids stay together, rows without one
    are in the last. The ranges are conditions on the column itself, which reach the scan."""
    id_ = F.col("doc_id") if dict(docs.dtypes)["doc_id"] in ("bigint", "int") else F.col("doc_id").cast("long")
    cuts = docs.select(F.percentile_approx(id_, F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10000))).first()[0] if n > 1 else None
    cuts = sorted({c for c in cuts or [] if c is not None})
    if not cuts:
        return [docs]
    return [docs.where(id_ <= cuts[0]), *(docs.where((id_ > a) & (id_ <= b)) for a, b in zip(cuts, cuts[1:])), docs.where((id_ > cuts[-1]) | id_.isNull())]


def lost_lines(docs: DataFrame, n: int = BATCHES, min_chars: int = MIN_CHARS, fanout: int = FANOUT) -> DataFrame:
    """All documents through the runs, batch by batch: ``(doc, t, dropped)``."""
    runs, out = LineRuns(docs.sparkSession, fanout), None
    try:
        for batch in batches(docs, n):
            lost = runs.add(batch, min_chars)
            out = lost if out is None else out.unionAll(lost)
    finally:
        runs.close()
    return out


def _with_lost(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with the column ``dropped``; the key columns of the lost lines cannot clash with a column of ``docs``."""
    lost = lost_lines(docs, **how)
    key, text, dropped = (f"{c}_{uuid.uuid4().hex}" for c in ("doc", "t", "dropped"))
    lost = lost.select(F.col("doc").alias(key), F.col("t").alias(text), F.col("dropped").alias(dropped))
    return docs.join(lost.hint("merge"), (owner_id() == F.col(key)) & (text_key() == F.col(text)), "left").drop(key, text)  # alike at every size


def kept_lines(text: str | None, dropped: list[int] | None) -> tuple[list[str], int]:
    """The lines that stay and the number of lines there were."""
    lines = (text or "").split("\n")
    if not dropped:
        return lines, len(lines)
    gone = set(dropped)
    return [line for i, line in enumerate(lines) if i not in gone], len(lines)


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, **how) -> DataFrame:
    """``docs`` with all columns, repeated lines taken out of ``text`` (a null text stays null).

    ``drop_emptied``: rows whose text has lost lines and has nothing but blanks left are left out."""
    joined = _with_lost(docs, **how)
    schema = arrow_schema(docs.schema)
    at = schema.get_field_index("text")

    def scan(found):
        for batch in found:
            for part in slices(batch):
                gone = part.column(part.num_columns - 1).to_pylist()
                texts = [t if not g else "\n".join(kept_lines(t, g)[0]) for t, g in zip(part.column(at).to_pylist(), gone)]
                if drop_emptied:
                    stays = [not g or bool(t.strip(BLANKS)) for t, g in zip(texts, gone)]
                    part, texts = part.filter(pa.array(stays, pa.bool_())), [t for t, s in zip(texts, stays) if s]
                columns = [pa.array(texts, schema.field(at).type) if i == at else part.column(i) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return joined.mapInArrow(scan, docs.schema)


def line_report(docs: DataFrame, **how) -> DataFrame:
    """Per document the lines before, the lines dropped, and the hash of what is left."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = arrow_schema(COLUMNS)

    def scan(found):
        for batch in found:
            for part in slices(batch):
                ids, texts, gone = (part.column(i).to_pylist() for i in range(3))
                kept = [kept_lines(t, g) for t, g in zip(texts, gone)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([n for _, n in kept], pa.int64()), pa.array([n - len(x) for x, n in kept], pa.int64()),
                     pa.array([hashlib.sha256("\n".join(x).encode()).hexdigest() for x, _ in kept])], schema=schema)

    return _with_lost(docs, **how).mapInArrow(scan, COLUMNS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_table(spark, sf_dir, "documents"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE = {"op3_line_dedup": """
WITH numbered AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM numbered),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
judged AS (
  SELECT doc_id, pos, line, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""}
