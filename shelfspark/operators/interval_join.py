"""Equi-key join with a date-range condition (``d BETWEEN start AND end``).

Spark evaluates a range predicate only as a residual of an equi-join, so the
candidates of a row are every right row of its key. Right rows are therefore
replicated into the fixed-width date buckets their interval covers and the
join key is extended with the bucket of the left row's date. A left row now
meets only the intervals that overlap its bucket, and every match is found in
exactly one bucket (the one holding the left date), so no de-duplication is
needed. Intervals are first cut to the dates the left side has, so that an open
one (to the year 9999) covers no more buckets than there are dates. The caller who
knows those dates passes them; otherwise one pass over the date column finds them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bucket(col, width: int):
    return F.floor(F.unix_date(col) / width).cast("bigint")


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], point: str,
                  start: str, end: str, bucket_days: int = 7, how: str = "inner",
                  dates: tuple[dt.date | None, dt.date | None] | None = None) -> DataFrame:
    """Rows of ``left`` × ``right`` with equal ``keys`` and
    ``right.start <= left.point <= right.end`` (inclusive, like BETWEEN).

    ``dates``: the first and last ``point`` of ``left``, or bounds around them."""
    low, high = dates or tuple(left.agg(F.min(point), F.max(point)).first())
    first = F.greatest(F.col(start), F.lit(low).cast("date"))
    last = F.least(F.col(end), F.lit(high).cast("date"))
    # An interval that is empty, or has no bound, or lies outside the dates can never satisfy BETWEEN.
    spread = (right.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)) & (first <= last))
              .withColumn("_ij_bucket", F.explode(F.sequence(_bucket(first, bucket_days), _bucket(last, bucket_days)))))
    probe = left.withColumn("_ij_bucket", _bucket(F.col(point), bucket_days))
    cond = [probe[k] == spread[k] for k in keys] + [probe["_ij_bucket"] == spread["_ij_bucket"],
                                                     probe[point].between(spread[start], spread[end])]
    joined = probe.join(spread, cond, how)
    return joined.drop(spread["_ij_bucket"]).drop(probe["_ij_bucket"]).drop(*[spread[k] for k in keys])
