"""Monitors with timers: an alert when a key stays silent, raised by event time.

``silence`` keeps the last day each key was seen and a timer at the day its silence
becomes too long. An event moves the timer; when the watermark passes it, the
alert is raised, once; the next event of the key calls it off. The state is one day and
one flag per key, whatever the number of events.

The watermark follows the events' days, ``late_days`` behind the latest. A *day-close* row
(``key`` null) moves it where no key reports any more: the daily run writes one when the
day's feed is complete. It is what raises the alerts of the last days.

``drain_silent_stores`` and ``drain_idle_items`` are the monitors P2 and P10 in this form:
they drain the feed folder that ``write_feed`` (or a point-of-sale export) fills and return
the alerts that stand, with the batch monitors' columns.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.plans.common import valid_sales
from shelfspark.plans.pipeline import IDLE_ITEM, SILENT_STORE, run_date
from shelfspark.session import scratch_path, session_folder
from shelfspark.sources.raw import RawTables

EVENT = "key string, day date, since date, event_time timestamp"
ALERT = "key string, last_day date, silent boolean, seq bigint"
CLOSE = ""     # the key of day-close rows inside the stream
DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.date(1970, 1, 1)


class Silence(StatefulProcessor):
    """Per key the last day seen, a timer ``limit`` days after it, and whether the alert stands."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # last: days since 1970 of the last event (of the day the key began, before any); seen: an event came; alert; changes so far
        self.state = handle.getValueState("silence", "last long, seen boolean, alert boolean, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == CLOSE:
            return
        last, seen, alert, seq = self.state.get() if self.state.exists() else (None, False, False, 0)
        before = last
        for frame in rows:
            days = frame["day"].dropna()
            if len(days):
                day = (max(days) - EPOCH).days
                last, seen = (max(last, day) if seen else day), True
            elif not seen:
                since = frame["since"].dropna()
                last = (min(since) - EPOCH).days if len(since) else last
        if last is None:
            return
        if last != before or alert:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.limit) * DAY_MS)
        off = alert and last != before
        self.state.update((last, seen, alert and not off, seq + off))
        if off:
            yield self.row(key, last, seen, False, seq + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, seen, alert, seq = self.state.get()
        if not alert:
            self.state.update((last, seen, True, seq + 1))
            yield self.row(key, last, seen, True, seq + 1)

    @staticmethod
    def row(key, last: int, seen: bool, silent: bool, seq: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "last_day": [EPOCH + dt.timedelta(days=last) if seen else None], "silent": [silent], "seq": [seq]})

    def close(self) -> None:
        pass


def silence(events: DataFrame, limit: int, late_days: int) -> DataFrame:
    """The stream of alerts raised and called off over a stream of ``EVENT`` rows."""
    keyed = events.withColumn("key", F.coalesce("key", F.lit(CLOSE))).withWatermark("event_time", f"{late_days} days")
    return keyed.groupBy("key").transformWithStateInPandas(Silence(limit), ALERT, "Append", "EventTime")


def as_event(key, day, since, at) -> list:
    return [key.cast("string").alias("key"), day.cast("date").alias("day"), since.cast("date").alias("since"), at.cast("timestamp").alias("event_time")]


def write_feed(folder: str, seen: DataFrame, began: DataFrame | None, close: dt.date, late_days: int, parts: int = 4) -> None:
    """Fill a feed folder from ``seen(key, day)``: the days in order, in ``parts`` files, the keys of ``began(key, since)``
    with the first ones, and the day-close rows of ``close``."""
    spark = seen.sparkSession
    none = F.lit(None)
    first, last = seen.agg(F.min("day"), F.max("day")).first()
    first, last = first or close, last or close
    if began is not None:
        began.select(as_event(F.col("key"), none, F.col("since"), F.lit(first))).write.mode("append").parquet(folder)
    edges = [first + (last - first) * i / parts for i in range(parts)] + [last + dt.timedelta(days=1)]
    for a, b in zip(edges, edges[1:]):
        part = seen.filter((F.col("day") >= F.lit(a)) & (F.col("day") < F.lit(b)))
        part.select(as_event(F.col("key"), F.col("day"), none, F.col("day"))).write.mode("append").parquet(folder)
    # The watermark stands late_days behind; a timer is looked at in the batch after the one that moved it.
    done = spark.createDataFrame([(close + dt.timedelta(days=late_days),)], "at date")
    for _ in range(2):
        done.select(as_event(none, none, none, F.col("at"))).write.mode("append").parquet(folder)


def drain(spark: SparkSession, folder: str, out: str, checkpoint: str, limit: int, late_days: int, files_per_trigger: int | None = None) -> DataFrame:
    """Drain the feed folder and return the alerts that stand: ``key``, ``last_day`` (null: never seen)."""
    reader = spark.readStream.schema(EVENT)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, ROCKSDB)   # timers and typed state need it
    try:
        query = (silence(reader.parquet(folder), limit, late_days).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    latest = spark.read.schema(ALERT).parquet(out).groupBy("key").agg(F.max_by(F.struct("last_day", "silent"), "seq").alias("now"))
    return latest.filter("now.silent").select("key", "now.last_day")


def _drained(t: RawTables, seen: DataFrame, began: DataFrame | None, limit: int) -> tuple[DataFrame, dt.date]:
    """The alerts on the run date over a feed folder written from ``seen`` and ``began``."""
    spark = t.spark
    close = t.transactions.select(run_date(t)).first()
    base = scratch_path(spark, f"{session_folder(spark)}/silence-{uuid.uuid4().hex}")
    if close is None or close[0] is None:
        return spark.createDataFrame([], "key string, last_day date"), EPOCH
    late = t.rules.late_window_days
    write_feed(f"{base}/feed", seen, began, close[0], late)
    return drain(spark, f"{base}/feed", f"{base}/alerts", f"{base}/checkpoint", limit, late), close[0]


def drain_silent_stores(t: RawTables) -> DataFrame:
    """P2 as a stream: the stores whose alert stands on the run date."""
    seen = t.transactions.select(F.col("store_id").alias("key"), F.col("transaction_date").alias("day")).distinct()
    began = t.stores.select(F.col("store_id").alias("key"), F.col("opening_date").alias("since"))
    alerts, close = _drained(t, seen, began, t.rules.silent_store_days)
    return (t.stores.join(alerts, F.col("store_id") == F.col("key"))
            .select("store_id", "store_name", "country", F.col("last_day").alias("ultima_fecha_datos"),
                    F.datediff(F.lit(close), F.coalesce("last_day", "opening_date")).cast("bigint").alias("dias_sin_datos"),
                    F.lit(SILENT_STORE).alias("alerta")))


def drain_idle_items(t: RawTables) -> DataFrame:
    """P10 as a stream: the (store, item) pairs whose alert stands on the run date."""
    pair = F.to_json(F.struct("store_id", "item_id"))
    seen = valid_sales(t).select(pair.alias("key"), F.col("transaction_date").alias("day")).distinct()
    alerts, close = _drained(t, seen, None, t.rules.idle_item_days)
    found = alerts.select(F.from_json("key", "store_id string, item_id string").alias("p"), "last_day").select("p.*", "last_day")
    return (found.join(t.products, "item_id")
            .select("store_id", "item_id", "item_name", "category", F.col("last_day").alias("ultima_venta"),
                    F.datediff(F.lit(close), F.col("last_day")).cast("bigint").alias("dias_sin_movimiento"), F.lit(IDLE_ITEM).alias("alerta")))


STREAM_JOBS = {"p2_silent_stores_stream": drain_silent_stores}
