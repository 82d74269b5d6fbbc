"""Hard-negative mining (12): LEMP-style coordinate pruning (``lemp.py``).

Components become floor(256 * x). Rows are dealt by hash into shards, anchors (rows
whose id is divisible by ``anchor_every``) into blocks; a task holds one shard and one
block. A shard's vectors stand in buckets of similar length, each with sorted lists
of all coordinates; an anchor's threshold gives feasible value ranges in its focus
coordinates, whose lists are intersected before exact verification. Two searches:

* positives: per anchor the best ``k`` other rows of its label, the threshold being
  the k-th best score so far;
* negatives: per anchor and positive the best ``k`` rows of other labels with
  ``low_percent`` * positive <= 100 * negative <= 100 * positive, the threshold being
  the range's lower end or the k-th best so far.

A task returns at most k rows per anchor (and positive); shards are merged by rank.

Rows whose id, label or vector is null, or that hold a null or non-finite component,
take no part. Rows alike in id, label and vector count once; rows that share an id
only are separate rows and may be each other's positives. Vectors of another number of
components have no score with an anchor. Scores must fit a long; a component beyond
the longs after scaling ends the job with Spark's overflow error. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, read_table, written
from shelfspark.llm.lemp import Index

SCALE = 256
# Fixed values of the query: relabelled rows, anchors, positives and negatives, score range.
RELABEL_EVERY, LABELS = 7, 10
ANCHOR_EVERY, K = 100, 5
LOW_PERCENT = 80
#: Numbers that a shard's vectors hold, about; shards at least; anchors in a block.
SHARD_FLOATS, SHARDS, BLOCK_ROWS = 1 << 21, 12, 1 << 13
FOUND = "anchor_id long, anchor_key long, positive_id long, positive_key long, id long, key long, score long, positive_score long"


def participants(embeddings: DataFrame, relabel_every: int | None = RELABEL_EVERY, labels: int = LABELS) -> DataFrame:
    """``(id, key, label, dim, x)`` of the rows that take part; key tells apart the rows of one id."""
    value = F.col("embedding")
    finite = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    if relabel_every:
        label = F.when(F.col("vec_id").cast("long") % relabel_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    rows = (embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(value, lambda v: F.floor(v.cast("double") * SCALE).cast("long")).alias("x")))
    return rows.distinct().select("id", F.xxhash64("label", "x").alias("key"), "label", F.size("x").alias("dim"), "x")


def matrix(column: pa.ChunkedArray, rows: int, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)


def index_of(shard: pa.Table) -> tuple[Index, np.ndarray]:
    """The shard's index and the keys of its rows."""
    x = matrix(shard.column("x"), shard.num_rows, shard.column("dim")[0].as_py())
    return Index(x, shard.column("id").to_numpy(), shard.column("label").to_numpy()), shard.column("key").to_numpy()


def searched(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, per_anchor) -> DataFrame:
    """``per_anchor(index, anchor row as dict, vector)`` over every anchor and shard; it gives lists for ``FOUND``'s last six columns."""
    schema = arrow_schema(FOUND)

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in schema]
        if shard.num_rows and block.num_rows:
            index, keys = index_of(shard)
            vectors = matrix(block.column("x"), block.num_rows, block.column("dim")[0].as_py())
            for q, anchor in zip(vectors, block.drop_columns(["x"]).to_pylist()):
                for positive, (found, scores) in per_anchor(index, anchor, q):
                    columns = ([anchor["id"]] * len(found), [anchor["key"]] * len(found), [positive["id"]] * len(found), [positive["key"]] * len(found),
                               index.ids[found].tolist(), keys[found].tolist(), scores.tolist(), [positive["score"]] * len(found))
                    for column, values in zip(out, columns):
                        column.extend(values)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    dealt = (rows.withColumn("shard", F.pmod(F.xxhash64("id", "key", F.lit(1)), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (anchors.withColumn("block", F.pmod(F.xxhash64("id", "key", F.lit(2)), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    by = ("dim", "shard", "block")
    asked = asked.select([F.col(c).alias(c) for c in asked.columns])  # new columns: both sides come from one table
    return dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, FOUND)


def ranked(found: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """The best k rows of each group, with ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, k: int = K, low_percent: int = LOW_PERCENT, anchor_every: int = ANCHOR_EVERY,
                   relabel_every: int | None = RELABEL_EVERY, shard_floats: int = SHARD_FLOATS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per anchor and positive the ranked negatives: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    rows = written(participants(embeddings, relabel_every), "quantised-vectors")
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(SHARDS, -(-size // shard_floats))
    anchors = rows.where(F.col("id") % anchor_every == 0)
    blocks = max(1, -(-anchors.count() // block_rows))
    none = {"id": None, "key": None, "score": None}

    def best(index: Index, anchor: dict, q: np.ndarray):
        return [(none, index.positives(q, anchor["label"], (anchor["id"], q), k))]

    found = searched(rows, anchors, shards, blocks, best).drop("positive_id", "positive_key", "positive_score")
    positives = ranked(found, ("anchor_id", "anchor_key"), k)
    lists = positives.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(
        F.collect_list(F.struct("id", "key", "score")).alias("positives"))  # k of them
    asked = written(anchors.join(lists, ["id", "key"]), "anchors-with-positives")

    def within(index: Index, anchor: dict, q: np.ndarray):
        # 100 * negative <= 100 * positive, and low_percent * positive rounded up to whole scores
        wanted = [p for p in anchor["positives"] if -(-low_percent * p["score"] // 100) <= p["score"]]
        ranges = [(-(-low_percent * p["score"] // 100), p["score"]) for p in wanted]
        return zip(wanted, index.negatives(q, anchor["label"], ranges, k))

    negatives = ranked(searched(rows, asked, shards, blocks, within), ("anchor_id", "anchor_key", "positive_id", "positive_key"), k)
    return negatives.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                            "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLE = {"op12_hard_negatives": """
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
score AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM vec a JOIN vec b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM score WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negative AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM positive JOIN score USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""}
