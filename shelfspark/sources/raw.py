"""The six raw retail tables as one object, with their readers and writers.

Three origins give the same ``RawTables``:

* ``from_csv``      — the original CSV exports, read with the declared schema
  (``from_csv_quarantined``: unreadable rows go to a side table);
* ``from_parquet``  — landed Parquet folders (the production layout);
* ``from_driver``   — derived on the fly from the TPC-H-style test tables.

No join is hinted: Spark broadcasts a side whose bytes are under its threshold,
at planning or at run time, and shuffles otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.rules import DEFAULT_RULES, Rules
from shelfspark.sources import driver_tables
from shelfspark.session import path_exists
from shelfspark.sources.csv_quarantine import read_quarantined
from shelfspark.sources.schemas import ITEM_FEED, RAW


@dataclass
class RawTables:
    spark: SparkSession
    transactions: DataFrame
    transaction_items: DataFrame
    stores: DataFrame
    products: DataFrame
    vendors: DataFrame
    store_promotions: DataFrame
    rules: Rules = DEFAULT_RULES
    # Incremental point-of-sale feed (line versions with ingestion time), when available.
    item_feed: DataFrame | None = None
    # Columns that all versions of a line share by the feed's definition; where the feed
    # is dealt by them already, versions are compared without another shuffle.
    versions_share: tuple[str, ...] = ()
    # Filtered item-grain sales computed once and shared by several reports
    # (see plans.daily.refresh_reports); None means derive them per job.
    shared_sales: DataFrame | None = None

    # ---- constructors --------------------------------------------------
    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str, rules: Rules = DEFAULT_RULES) -> "RawTables":
        frames = {name: build(spark, sf_dir) for name, build in driver_tables.BUILDERS.items()}
        return cls(spark=spark, rules=rules, item_feed=driver_tables.item_feed(spark, sf_dir),
                   versions_share=driver_tables.VERSIONS_SHARE, **frames)

    @classmethod
    def from_parquet(cls, spark: SparkSession, base: str, rules: Rules = DEFAULT_RULES) -> "RawTables":
        base = base.rstrip("/")
        frames = {name: spark.read.schema(schema).parquet(f"{base}/{name}") for name, schema in RAW.items()}
        feed = None
        if path_exists(spark, f"{base}/item_feed"):
            feed = spark.read.schema(ITEM_FEED).parquet(f"{base}/item_feed")
        return cls(spark=spark, rules=rules, item_feed=feed, **frames)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, rules: Rules = DEFAULT_RULES) -> "RawTables":
        """From catalog tables (e.g. written by ``land_bucketed``)."""
        frames = {name: spark.table(f"{database}.{name}") for name in RAW}
        feed = spark.table(f"{database}.item_feed") if spark.catalog.tableExists(f"{database}.item_feed") else None
        return cls(spark=spark, rules=rules, item_feed=feed, **frames)

    @classmethod
    def from_csv(cls, spark: SparkSession, base: str, rules: Rules = DEFAULT_RULES,
                 date_format: str = "yyyy-MM-dd") -> "RawTables":
        def read(name):
            return (spark.read.schema(RAW[name]).option("header", True)
                    .option("dateFormat", date_format).option("mode", "FAILFAST")
                    .csv(f"{base.rstrip('/')}/{name}.csv"))
        return cls(spark=spark, rules=rules, **{name: read(name) for name in RAW})

    @classmethod
    def from_csv_quarantined(cls, spark: SparkSession, base: str, rules: Rules = DEFAULT_RULES,
                             date_format: str = "yyyy-MM-dd") -> tuple["RawTables", DataFrame]:
        """Like ``from_csv``, but what cannot be read goes to a side table: the tables, and the quarantined lines of all of
        them (with ``table_name``, file, line number and reason)."""
        loads = {name: read_quarantined(spark, f"{base.rstrip('/')}/{name}.csv", schema, date_format) for name, schema in RAW.items()}
        bad = None
        for name, load in loads.items():
            mine = load.quarantine.select(F.lit(name).alias("table_name"), "*")
            bad = mine if bad is None else bad.unionByName(mine)
        return cls(spark=spark, rules=rules, **{name: load.rows for name, load in loads.items()}), bad

    @classmethod
    def from_frames(cls, spark: SparkSession, rules: Rules = DEFAULT_RULES, **frames: DataFrame) -> "RawTables":
        """From in-memory frames (tests); columns are cast to the declared schema."""
        typed = {}
        for name, schema in RAW.items():
            df = frames[name]
            typed[name] = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        return cls(spark=spark, rules=rules, **typed)

    def with_rules(self, rules: Rules) -> "RawTables":
        return RawTables(self.spark, self.transactions, self.transaction_items, self.stores,
                         self.products, self.vendors, self.store_promotions, rules, self.item_feed,
                         self.versions_share, self.shared_sales)

    def register_views(self) -> None:
        """Expose the raw tables (and the feed) to Spark SQL under their names."""
        for name in RAW:
            self.table(name).createOrReplaceTempView(name)
        if self.item_feed is not None:
            self.item_feed.createOrReplaceTempView("item_feed")

    # ---- access --------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    # ---- sink ----------------------------------------------------------
    def land_bucketed(self, database: str, buckets: int, location: str | None = None,
                      bucketed: tuple[str, ...] = ("transactions", "transaction_items")) -> "RawTables":
        """Write the tables as catalog tables, transactions and their items both
        bucketed and sorted by ``transaction_id`` into the same number of buckets.

        The items ⋈ transactions join of every report then runs bucket by
        bucket, without an exchange of either side; filters and lookups in
        between keep that partitioning. Master tables and the feed are written
        plain.

        A bucketed join has no shuffle for adaptive execution to split. Where one
        transaction may hold more lines than a bucket should, the caller lands
        the tables plain (``bucketed=()``), and the shuffle join's skew splitting
        applies."""
        bucket_by = bucketed
        where = f" LOCATION '{location}'" if location else ""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
        for name in RAW:
            df = self.table(name)
            if name in bucket_by:
                # Same hash as the buckets: each task writes exactly one bucket file,
                # instead of every task writing a file for every bucket.
                df = df.repartition(buckets, "transaction_id")
            writer = df.write.mode("overwrite").format("parquet")
            if name in bucket_by:
                writer = writer.bucketBy(buckets, "transaction_id").sortBy("transaction_id")
            writer.saveAsTable(f"{database}.{name}")
        if self.item_feed is not None:
            self.item_feed.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.item_feed")
        return RawTables.from_catalog(self.spark, database, self.rules)

    def land(self, base: str, mode: str = "overwrite") -> "RawTables":
        """Write all six tables (and the feed, if any) as Parquet folders and
        return readers over them. Sales tables are written clustered by their
        join key so that row-group statistics prune well."""
        base = base.rstrip("/")
        for name in RAW:
            df = self.table(name)
            if name in ("transactions", "transaction_items"):
                df = df.sortWithinPartitions("transaction_id")
            df.write.mode(mode).parquet(f"{base}/{name}")
        if self.item_feed is not None:
            self.item_feed.sortWithinPartitions("ingestion_timestamp").write.mode(mode).parquet(f"{base}/item_feed")
        return RawTables.from_parquet(self.spark, base, self.rules)
