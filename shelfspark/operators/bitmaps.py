"""Exact distinct counts that can be merged: bitmaps over dense keys.

A dense key (a dimension's surrogate key) is a bit of a bitmap of 32,768 keys. A set is a row
per bitmap that has a bit; sets of days are OR-ed into sets of any period, AND-ed
with others, and counted, without a key crossing a shuffle again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_sets(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The set of ``key``s of each ``by``: rows ``by``, ``bucket``, ``bits``. Null keys are in no set."""
    return (df.filter(F.col(key).isNotNull()).groupBy(*by, F.bitmap_bucket_number(key).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits")))


def united(sets: DataFrame, by: Sequence) -> DataFrame:
    """The unions of the sets over coarser ``by`` (columns or expressions)."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The number of keys of each ``by``."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias(name))


def shared(a: DataFrame, b: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The intersections of the sets of ``a`` and ``b`` that agree in ``on``, named by ``by``."""
    both = a.join(b.withColumnRenamed("bits", "_bits"), [*on, "bucket"])
    pair = both.withColumn("bits", F.explode(F.array("bits", "_bits")))
    return pair.groupBy(*by, "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
