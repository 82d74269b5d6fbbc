"""Helpers shared by the operators: input projection, Arrow scans, scratch tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import shelfspark
from shelfspark.session import scratch_path

#: Texts handled together inside a task, in characters; a longer text is a slice of its own.
SLICE_CHARS = 1 << 20


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per Spark context, so that tasks can import it wherever they start.

    A package that was itself sent as an archive (``--py-files``) is left alone.
    """
    root, context = Path(shelfspark.__file__).resolve().parent, spark.sparkContext
    if getattr(context, "shipped_package", None) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context.shipped_package = str(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators look at, so that other columns, whatever their names, cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow form of a DDL string or of a DataFrame's schema."""
    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """A record batch cut so that each piece holds at most ``SLICE_CHARS`` of text or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(docs: DataFrame, per_slice: Callable[[list, list], dict[str, list]], ddl: str) -> DataFrame:
    """``per_slice(doc_ids, texts)`` over whole texts, in Arrow batches of bounded size; returns columns named as in ``ddl``."""
    schema = arrow_schema(ddl)

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                out = per_slice(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return id_and_text(docs).mapInArrow(scan, ddl)


def written(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of ``counts`` with the largest ``n``, at most ``size``: whole bins of a log scale from the top.

    The driver sees a few hundred bins; ``counts`` is read twice and should be a written table."""
    bin_ = F.floor(F.log2("n") * 16).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r["bin"]):
        if held + r["rows"] > size:
            break
        least, held = r["bin"], held + r["rows"]
    return counts.where(bin_ >= least)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; every operator takes the path as a parameter and uses this as its default."""
    import public_tokenizers

    return public_tokenizers.path(name)
