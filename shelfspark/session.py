"""SparkSession helpers.

Jobs never create their own session; they take one. ``local_session`` is for
tests, the bench and the smoke entry point. On a cluster the submitter owns the
configuration, ``spark.checkpoint.dir`` included: intermediate tables go there.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates, adaptive execution (runtime
# coalescing, skew-join splitting, broadcast conversion), ANSI arithmetic.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


#: Intermediate tables are written once and read a few times: fewer bytes count for more than the time to pack them.
SCRATCH_CODEC = "zstd"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "shelfspark",
                  extra_conf: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**BASE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
               bucket_bytes: int = 1 << 30) -> dict:
    """Settings sized to the data: about one shuffle partition per 256 MB of
    input (never fewer than two per core), AQE coalescing toward the same size,
    and input splits of 128 MB. ``buckets`` is a bucket count for
    ``RawTables.land_bucketed``: about 1 GB per bucket file, a power of two (so
    tables can be co-bucketed), at least one per core."""
    partitions = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    wanted = max(total_cores, -(-input_bytes // bucket_bytes))
    buckets = 1 << max(0, (wanted - 1).bit_length())
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "buckets": buckets,
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` or from the Spark context. Only in local
    mode, where one machine does everything, an unset folder is replaced by a
    fresh scratch one; on a cluster it is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    existing = spark.sparkContext.getCheckpointDir()
    if existing:                      # set on the context by the application
        return existing
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="shelfspark-ckpt-", dir=os.environ.get("SHELFSPARK_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written intermediate table."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared checkpoint folder and read back, for results that outlive the call.

    Lineage ends there. ``clear_scratch`` deletes what a session has left."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{session_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", SCRATCH_CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session_folder(spark: SparkSession) -> str:
    """The name of this application's own folder inside the checkpoint folder."""
    return f"session-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the written intermediate tables of this application; its lazy results can't be read any more."""
    delete_path(spark, scratch_path(spark, session_folder(spark)))


#: For jobs of many statements over tables written in buckets: shuffle files go when their statement ends (else they stay until the driver
#: collects its garbage), buckets are read as such wherever they may help, and rows dealt by some of a join's keys are not dealt again by all.
SPARING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """Statements inside are planned and run with ``SPARING``; the session's own settings come back after."""
    before = {k: spark.conf.get(k) for k in SPARING}
    for k, v in SPARING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, on whatever file system Spark reads it from; nothing is listed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system Spark reads it from; one that is not there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def replace_folder(df: DataFrame, path: str) -> None:
    """Replace the Parquet folder ``path`` by ``df``, which must not be reading it. The new folder is complete before the old
    one goes; if the job ends in between, ``recover_folder`` finishes the exchange."""
    spark, path = df.sparkSession, path.rstrip("/")
    df.write.mode("overwrite").parquet(f"{path}.next")
    delete_path(spark, path)
    recover_folder(spark, path)


def recover_folder(spark: SparkSession, path: str) -> None:
    """Put the folder that was to replace ``path`` in its place, if ``path`` is missing and the other one complete."""
    path = path.rstrip("/")
    if not path_exists(spark, path) and path_exists(spark, f"{path}.next/_SUCCESS"):
        source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.next", path))
        source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target)


class Generations:
    """A small table under ``path`` that is replaced as a whole: each generation is a folder of its own, and the
    greatest generation in the append-only list beside them is the current one. A replacement that fails half-way
    leaves the old generation current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.list = f"{self.path}/generations"

    def latest(self) -> tuple[int, int]:
        """The current generation (0 if there is none) and the number noted with it."""
        if not path_exists(self.spark, self.list):
            return 0, 0
        best = self.spark.read.schema("generation bigint, note bigint").parquet(self.list).orderBy("generation", ascending=False).first()
        return tuple(best) if best else (0, 0)

    def folder(self, generation: int) -> str:
        return f"{self.path}/g{generation}"

    def read(self, schema) -> DataFrame | None:
        now, _ = self.latest()
        return self.spark.read.schema(schema).parquet(self.folder(now)) if now else None

    def replace(self, df: DataFrame) -> None:
        """Write ``df``, make it current, and delete the generation before it."""
        now, _ = self.latest()
        df.write.mode("overwrite").parquet(self.folder(now + 1))
        self.switch(now)

    def switch(self, now: int, note: int = 0) -> None:
        """Make the generation after ``now`` current and delete ``now``."""
        self.spark.createDataFrame([(now + 1, note)], "generation bigint, note bigint").coalesce(1).write.mode("append").parquet(self.list)
        if now:
            delete_path(self.spark, self.folder(now))


class Scratch:
    """A database of intermediate tables inside the shared checkpoint folder; ``drop`` and ``close`` delete their files."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name, self.made = spark, f"scratch_{uuid.uuid4().hex[:12]}", 0
        spark.sql(f"CREATE DATABASE {self.name} LOCATION '{scratch_path(spark, self.name)}'")

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def keep(self, df: DataFrame, buckets: int = 0, by: tuple[str, ...] = ()) -> str:
        """Writes ``df`` as a table, bucketed and sorted if asked for, and returns its name."""
        self.made += 1
        name = f"{self.name}.t{self.made}"
        writer = df.write.format("parquet").option("compression", SCRATCH_CODEC)
        if buckets:
            writer = writer.bucketBy(buckets, *by).sortBy(*by)
        writer.saveAsTable(name)
        return name

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` read back from a table of this database."""
        return self.spark.table(self.keep(df))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")
