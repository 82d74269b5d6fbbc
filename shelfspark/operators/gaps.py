"""Gaps between consecutive dates of a key (freshness, stock-outs, idle items)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consecutive_gaps(days: DataFrame, keys: Sequence[str], date_col: str, min_gap: int) -> DataFrame:
    """Rows of ``days`` (one per key and date) whose distance to the previous
    date of the same key is at least ``min_gap`` days, with ``prev_date`` and
    ``gap_days`` (BIGINT).

    ``days`` should already be reduced to distinct (key, date) pairs: each
    window partition then holds at most one row per calendar day, so a key with
    a huge share of the raw rows still yields a small, bounded partition.
    """
    w = Window.partitionBy(*keys).orderBy(date_col)
    return (days.withColumn("prev_date", F.lag(date_col).over(w))
            .withColumn("gap_days", F.datediff(F.col(date_col), F.col("prev_date")).cast("bigint"))
            .filter(F.col("gap_days") >= min_gap))


def trailing_silence(last_seen: DataFrame, as_of, key_cols: Sequence[str], min_days: int) -> DataFrame:
    """Keys whose last activity is at least ``min_days`` before ``as_of``
    (gaps still open at the end of the data, which ``consecutive_gaps`` cannot see)."""
    return (last_seen.withColumn("dias_sin_datos", F.datediff(as_of, F.col("last_date")).cast("bigint"))
            .filter(F.col("dias_sin_datos") >= min_days))
