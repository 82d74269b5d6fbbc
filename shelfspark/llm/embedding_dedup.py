"""Embedding near-dedup (9): hierarchical navigable small-world graphs per shard (``hnsw.py``).

Equal vectors form classes first. The classes' vectors are dealt by hash into
shards; each shard's graph is built in one task and written to the shared
folder, its beam widened until an audit with planted neighbours at the threshold
finds ``AUDIT`` of them. Every vector queries every shard, in blocks; a beam that
is full of links is searched again, wider, so large groups are found whole. Each
hit is verified by the cosine in double precision. A task returns per query the
number of links and, from its links, only a spanning forest, whose edges are
united on Spark.

Recall: the audit's target is 0.98; measured against brute force in the README.
Links are symmetric in truth but each direction is searched on its own, so a
missed one shows in one row's ``n_links`` only and the components keep it.

Vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, as do vectors of different lengths and rows without vec_id (which
have no component and are not kept). Rows that share a vec_id are one node of
the components; each row counts its links on its own, equal rows linking each
other. Labels and other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, read_table, written
from shelfspark.llm.graph import components
from shelfspark.llm.hnsw import Hnsw

COSINE = 0.9
AUDIT = 0.98
#: Shards at least, and the numbers that a shard's vectors hold at most.
SHARDS, SHARD_FLOATS = 8, 1 << 25
#: Queries that a task searches.
BLOCK_ROWS = 1 << 14
#: How far a single-precision similarity may be off; candidates within it are verified.
SLACK = 1e-4


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as a matrix, in the column's own precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest component is divided out first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the smallest id its edges ``a - b`` lead to."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[:len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            away = label != np.arange(len(ids))
            return ids[away], ids[label[away]]
        label = new


GRAPH = "dim int, shard int, graph binary"
FOUND = "kind int, rep long, k long, n long, other long"


def linked(classes: DataFrame, shards: int, blocks: int, cosine: float) -> DataFrame:
    """For ``classes(rep, k, mult, dim, embedding)``: per class and shard its links (kind 0), and forest edges (kind 1)."""
    graph_schema, found_schema = arrow_schema(GRAPH), arrow_schema(FOUND)

    def build(table: pa.Table) -> pa.Table:
        x = vectors_of(table.column("embedding"))
        graph = Hnsw.build(unit(x).astype(np.float32)).audited(cosine, AUDIT)
        parts = {"x": x, "rep": table.column("rep").to_numpy(), "k": table.column("k").to_numpy(), "mult": table.column("mult").to_numpy(),
                 "levels": [(v.nodes.astype(np.int32), v.links.astype(np.int32)) for v in graph.levels], "beam": graph.beam}
        out = io.BytesIO()
        pickle.dump(parts, out, protocol=5)
        return pa.Table.from_arrays([pa.array([table.column(c)[0].as_py()], f.type) for c, f in zip(("dim", "shard"), graph_schema)]
                                    + [pa.array([out.getvalue()], pa.binary())], schema=graph_schema)

    def query(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        from shelfspark.llm.hnsw import Level

        if not queries.num_rows or not graphs.num_rows:
            return found_schema.empty_table()
        parts = pickle.loads(graphs.column("graph")[0].as_py())
        nodes = unit(parts["x"])
        graph = Hnsw(nodes.astype(np.float32), [Level(n.astype(np.int64), e.astype(np.int64)) for n, e in parts["levels"]], parts["beam"])
        q = unit(vectors_of(queries.column("embedding")))
        rep, k = queries.column("rep").to_numpy(), queries.column("k").to_numpy()
        total, froms, tos = np.zeros(len(q), np.int64), [], []
        for a in range(0, len(q), 1024):
            i, j = graph.within(q[a:a + 1024].astype(np.float32), cosine - SLACK)
            i = i + a
            good = (rep[i] != parts["rep"][j]) | (k[i] != parts["k"][j])
            i, j = i[good], j[good]
            near = np.concatenate([np.einsum("nd,nd->n", q[i[s:s + 65536]], nodes[j[s:s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            i, j = i[near >= cosine], j[near >= cosine]
            np.add.at(total, i, parts["mult"][j])
            u, v = forest(rep[i], parts["rep"][j])
            froms.append(u)
            tos.append(v)
        u, v = forest(np.concatenate(froms), np.concatenate(tos))
        some = np.flatnonzero(total)
        columns = (np.repeat([0, 1], [len(some), len(u)]), np.concatenate([rep[some], u]), np.concatenate([k[some], np.zeros(len(u), np.int64)]),
                   np.concatenate([total[some], np.zeros(len(u), np.int64)]), np.concatenate([np.zeros(len(some), np.int64), v]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found_schema)], schema=found_schema)

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep", "k"), F.lit(shards)).cast("int"))
    graphs = written(dealt.groupBy("dim", "shard").applyInArrow(build, GRAPH), "hnsw")
    queries = (classes.withColumn("block", F.pmod(F.xxhash64("k", "rep", F.lit(1)), F.lit(blocks)).cast("int"))
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return queries.groupBy("dim", "shard", "block").cogroup(graphs.groupBy("dim", "shard", "block")).applyInArrow(query, FOUND)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: ``vec_id``, links to other rows, component, and whether it is the one that stays."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    valid = F.col("vec_id").isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0)
    classes = (rows.where(F.coalesce(valid, F.lit(False))).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"))
               .select("rep", F.xxhash64("embedding").alias("k"), "mult", F.size("embedding").alias("dim"), "embedding"))
    classes = written(classes, "vector-classes")
    n, dim = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards = max(SHARDS, -(-n * dim // SHARD_FLOATS))
    found = written(linked(classes, shards, max(1, -(-n // BLOCK_ROWS)), cosine), "vector-links")
    component = components(found.where("kind = 1").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.where("kind = 0").groupBy("rep", "k").agg(F.sum("n").alias("links"))
    known = (classes.join(links, ["rep", "k"], "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
             .select(F.col("embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("links"),
                     F.coalesce("component", "rep").alias("component")))
    out = rows.join(known, (F.col("embedding") == F.col("same")) & F.col("vec_id").isNotNull(), "left")
    component_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
ORACLE = {"op9_embedding_dedup": """
WITH RECURSIVE vec AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
scaled AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM vec WHERE list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS origin, vec_id AS spot FROM embeddings
  UNION
  SELECT r.origin, l.b FROM reach r JOIN link l ON l.a = r.spot)
SELECT v.vec_id, coalesce(n.links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v LEFT JOIN (SELECT a, count(*) AS links FROM link GROUP BY a) n ON n.a = v.vec_id
JOIN (SELECT origin, min(spot) AS component_id FROM reach GROUP BY origin) c ON c.origin = v.vec_id
"""}
