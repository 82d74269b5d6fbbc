"""Structured Streaming form of the incremental pipeline.

``start_fact_loader`` reads the point-of-sale feed folder as a file stream and
applies every micro-batch with the same batch function as the daily job
(``plans.pipeline.apply_increment``: latest version per line, late flag, star
lookups, partition-scoped upsert). The stream checkpoint is the high-water
mark: a file is marked processed only after its batch has been upserted, and
a batch replayed after a failure is absorbed by the idempotent upsert. With
``available_now`` the query drains what has arrived and stops — the daily
(or six-hourly, per scope) run.

``daily_store_gmv`` is the event-time view of the same feed: GMV per store and
sale day from the latest version of each line, with a watermark equal to the
late-data window (48 h), so a day's total is emitted once no more late lines
are accepted for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.functions.money import as_money, line_amount
from shelfspark.plans.pipeline import Scope, apply_increment
from shelfspark.sources.raw import RawTables
from shelfspark.sources.schemas import ITEM_FEED


def feed_stream(spark: SparkSession, feed_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ITEM_FEED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(feed_dir)


def start_fact_loader(t: RawTables, feed_dir: str, base: str, checkpoint_location: str, scope: Scope | None = None,
                      available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Bring arriving feed files into the model written under ``base`` (its dimensions must exist)."""
    def apply(batch: DataFrame, epoch_id: int) -> None:
        apply_increment(t, base, feed=batch, scope=scope)

    writer = (feed_stream(t.spark, feed_dir, max_files_per_trigger).writeStream
              .foreachBatch(apply).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="6 hours")
    return writer.start()


def daily_store_gmv(feed: DataFrame, late_hours: int = 48) -> DataFrame:
    """Streaming GMV per (store, sale day) of completed, positively priced lines.

    Two chained event-time aggregations under one watermark (the late window):
    first the latest version of each line within its sale day (latest
    ingestion, then record id — the batch rule), then the day's sum per store.
    A day is emitted once the watermark has passed it, i.e. when no more late
    lines are accepted for it. A correction that moves a line to another day
    reaches the numbers through the fact upsert, not through this view. Lines that
    come after the watermark are not in it; Spark counts them per trigger as
    ``numRowsDroppedByWatermark`` of the query's state operators."""
    versions = (feed.withColumn("event_time", F.col("transaction_date").cast("timestamp"))
                .withWatermark("event_time", f"{late_hours} hours"))
    latest = (versions.groupBy(F.window("event_time", "1 day").alias("day"), "store_id", "transaction_item_id")
              .agg(F.max_by(F.struct("status", "unit_price", "quantity"),
                            F.struct("ingestion_timestamp", "source_record_id")).alias("v")))
    lines = (latest.filter((F.col("v.status") == "COMPLETED") & (F.col("v.unit_price") > 0))
             .select("store_id", F.window_time("day").alias("day_time"),
                     line_amount("v.unit_price", "v.quantity").alias("amount")))
    return (lines.groupBy(F.window("day_time", "1 day").alias("day"), "store_id")
            .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("lines"))
            .select("store_id", F.to_date(F.col("day.start")).alias("transaction_date"),
                    as_money("amount").alias("gmv"), "lines"))
