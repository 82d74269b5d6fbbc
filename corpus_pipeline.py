"""A training-data pipeline over ``documents``.

Five stages, each working on all that its predecessor kept and written as Parquet
before the next: language ID (documents without a recognisable language go), line
dedup (repeated lines go, and documents that consisted of them), n-gram Jaccard join (one
document of each group of near-copies stays), benchmark decontamination (documents that
hold a benchmark window go), BPE encoding and decoding (ids and decoded text, as counts
and hashes).

Defined results: a null or empty text, or one without letters, has no language and goes
in the first stage. Rows that share a doc_id are separate rows; exact copies among them lose
no lines to each other in line dedup (they are one document there). Rows without doc_id count as
the last document in line dedup, are never near-copies, and stay. Very long texts are read
whole. Columns beyond those used pass through the first four stages, whatever
their names. An empty table gives an empty result; without benchmark items nothing is
contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import bpe_codec, decontamination, jaccard_join, language_id, line_dedup
from shelfspark.llm.common import read_table, ship_package, tokenizer_path, written

#: Languages come from a trained network, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language_id.with_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates),
          ("decontamination", benchmark), ("bpe_codec", codec)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
