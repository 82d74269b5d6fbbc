"""Overlaps of intervals by a sweep over their starts and ends, without joining them to each other.

An interval is two events: +1 on its first day, -1 on the day after its last. Events are
summed per group, class and day, so that a group with millions of intervals brings a row
per day. A first sweep per (group, class) gives the days on which the class is
active at all; a second one per group counts the active classes. What lies between two events with
two or more of them is an overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_overlaps(intervals: DataFrame, group: Sequence[str], class_col: str, start: str, end: str, least: int = 2) -> DataFrame:
    """Maximal stretches of days on which at least ``least`` classes of a group have an interval (both ends included):
    ``group``, ``overlap_start``, ``overlap_end``, ``days`` and ``most`` (classes active at once).

    Intervals without a bound or class, or that end before they start, count for nothing."""
    group = list(group)
    real = intervals.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(class_col).isNotNull() & (F.col(start) <= F.col(end)))
    events = (real.select(*group, F.col(class_col).alias("_class"),
                          F.explode(F.array(F.struct(F.col(start).alias("day"), F.lit(1).alias("step")),
                                            F.struct(F.date_add(end, 1).alias("day"), F.lit(-1).alias("step")))).alias("e"))
              .groupBy(*group, "_class", "e.day").agg(F.sum("e.step").alias("step")))
    active = F.sum("step").over(Window.partitionBy(*group, "_class").orderBy("day")) > 0
    order = Window.partitionBy(*group, "_class").orderBy("day")
    turns = (events.withColumn("on", active).withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False)))
             .filter(F.col("on") != F.col("was"))
             .groupBy(*group, "day").agg(F.sum(F.when(F.col("on"), 1).otherwise(-1)).alias("step")))
    by_day = Window.partitionBy(*group).orderBy("day")
    counted = (turns.withColumn("classes", F.sum("step").over(by_day)).withColumn("until", F.lead("day").over(by_day))
               .withColumn("many", F.col("classes") >= least)
               .withColumn("new", F.when(F.col("many") & ~F.coalesce(F.lag("many").over(by_day), F.lit(False)), 1).otherwise(0)))
    stretch = F.sum("new").over(by_day)
    return (counted.withColumn("_stretch", stretch).filter("many").groupBy(*group, "_stretch")
            .agg(F.min("day").alias("overlap_start"), F.date_sub(F.max("until"), 1).alias("overlap_end"),
                 F.max("classes").alias("most"))
            .select(*group, "overlap_start", "overlap_end",
                    (F.datediff("overlap_end", "overlap_start") + 1).cast("bigint").alias("days"), F.col("most").cast("bigint").alias("most")))
