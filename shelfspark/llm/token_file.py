"""Token-id output (10): a wavelet matrix per segment of each shard's file.

Documents are range-partitioned and sorted by id, encoded, each closed by the
end id, and written as Parquet files, one per shard. A row of a file is a
*segment*: whole documents of together about ``SEGMENT_TOKENS`` ids as a wavelet
matrix (bit-planes, rank directories, zero counts), with the documents' ids and
lengths. One compressed file thus serves reading, counting and finding of ids.
Spark's writer commits the files, so a lost executor leaves no half shard.

Ids are those of the tokenizers library. Texts within Latin-1 take tiktoken's
merge loop over the same vocabulary (three times as fast); texts beyond it, and
texts with very long pre-tokens, take the library and the exact merges.

Null text is an empty text (its end id only). One row is returned per input row;
rows that share an id stand next to each other, by text; null ids come first.
An empty table gives an empty index and an empty result. Other columns are not
read. A text of any length is one segment at least.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.bpe import BEYOND_LATIN, Bpe, bpe_of, read_spec
from shelfspark.llm.common import arrow_schema, id_and_text, read_table, slices, tokenizer_path
from shelfspark.llm.wavelet import WaveletMatrix
from shelfspark.session import scratch_path

END_ID = 2
SEGMENT_TOKENS = 1 << 20
#: Byte-level pre-tokens (fixed by the tokenizer file's ByteLevel pre-tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
SEGMENT = ("shard int, segment int, offset long, n long, doc_ids array<long>, lengths array<long>, "
           "zeros array<long>, planes array<binary>, ranks array<binary>")
COLUMNS = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long"


class Ids:
    """Text to ids."""

    def __init__(self, spec: str):
        import tiktoken

        self.bpe: Bpe = bpe_of(spec)
        ranks = {b: i for i, b in self.bpe.bytes_of.items() if i not in self.bpe.special.values()}
        self.fast = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.bpe.special)

    def __call__(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text):
            ids: list[int] = []
            for part in self.bpe.parts(text):
                if part in self.bpe.special:
                    ids.append(self.bpe.special[part])
                else:
                    for word in self.bpe.pre_tokens(part):
                        ids += self.bpe.merge(word)
            return np.array(ids, np.uint32)
        if BEYOND_LATIN.search(text):
            return np.array(self.bpe.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


@lru_cache(maxsize=2)
def ids_of(spec: str) -> Ids:
    """One encoder per worker process."""
    return Ids(spec)


def write_index(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS,
                shards: int | None = None) -> None:
    """The files of ``docs`` under ``path``, one per shard, shards and rows in ascending id order."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spec = read_spec(tokenizer)
    shared = spark.sparkContext.broadcast(spec)  # bounded by the vocabulary
    top = max(end_id, *bpe_of(spec).vocab.values(), *bpe_of(spec).special.values())
    bits, schema = max(1, top.bit_length()), arrow_schema(SEGMENT)
    kind = np.uint16 if bits <= 16 else np.uint32

    def encode(batches):
        ids, shard = ids_of(shared.value), TaskContext.get().partitionId()
        held: list[tuple[int, np.ndarray]] = []
        size = segment = offset = 0

        def out():
            matrix = WaveletMatrix.build(np.concatenate([x for _, x in held]), bits)
            row = (shard, segment, offset, matrix.n, [d for d, _ in held], [len(x) for _, x in held], matrix.zeros,
                   [p.tobytes() for p in matrix.planes], [r.tobytes() for r in matrix.ranks])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    held.append((doc, np.append(ids(text or ""), np.uint32(end_id)).astype(kind)))
                    size += len(held[-1][1])
                    if size >= segment_tokens:
                        yield out()
                        held, segment, offset, size = [], segment + 1, offset + size, 0
        if held:
            yield out()

    (id_and_text(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, SEGMENT).write.option("compression", "zstd").parquet(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


def matrix_of(row: dict) -> WaveletMatrix:
    """The wavelet matrix of one segment, its arrays being views of the row's bytes."""
    return WaveletMatrix(row["n"], [np.frombuffer(p, np.uint8) for p in row["planes"]],
                         [np.frombuffer(r, np.uint32) for r in row["ranks"]], row["zeros"])


def segments(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def documents_of(index: DataFrame) -> DataFrame:
    """Per document, read from the files: ``start`` (ids before it in the whole index), length and checksum of its ids."""
    schema = arrow_schema(COLUMNS)

    def decode(batches):
        for batch in batches:
            for row in segments(batch):
                tokens = matrix_of(row).tokens().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(crc), pa.int32()), pa.array(starts + row["offset"], pa.int64()),
                     pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    totals = index.groupBy("shard").agg(F.sum("n").alias("total"))  # a row per shard
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    return (index.mapInArrow(decode, COLUMNS).join(before, "shard")
            .select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def occurrences(index: DataFrame, token: int) -> DataFrame:
    """``(doc_id, position)`` of every occurrence of a token, by rank and select inside each segment."""
    schema = arrow_schema("doc_id long, position long")

    def find(batches):
        for batch in batches:
            for row in segments(batch):
                at = np.array(matrix_of(row).positions(token), np.int64)
                ends = np.cumsum(row["lengths"])
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc.tolist()], pa.int64()),
                                                  pa.array(at - (ends - row["lengths"])[doc], pa.int64())], schema=schema)

    return index.mapInArrow(find, "doc_id long, position long")


def count(index: DataFrame, token: int) -> int:
    """Occurrences of a token in the whole index, by rank alone."""
    schema = arrow_schema("n long")

    def ranks(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matrix_of(row).rank(token) for row in segments(batch)], pa.int64())], schema=schema)

    return int(index.mapInArrow(ranks, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"token-file-{uuid.uuid4().hex[:12]}")
    write_index(read_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return documents_of(read_index(spark, path))


QUERIES = {"op10_token_file": op10_token_file}
ORACLE: dict[str, str] = {}
