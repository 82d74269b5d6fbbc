"""Dense surrogate keys 1..n in the order of some columns.

SQL's ``ROW_NUMBER() OVER (ORDER BY k)`` runs in Spark as one task holding every
row. Here the input is written once, then dealt into range partitions of the order, each
sorted, with their rows' place in it (``monotonically_increasing_id``: partition and
row). What is left is one count per partition, turned into offsets, and

    key = rows of the partitions before + place in the partition.

The number of ranges follows the number of rows; a table of one range's size skips the
sampling that range partitioning needs. The written table also fixes the keys: a task
that is run again reads the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import scratch_table

#: Rows of a range, about.
RANGE_ROWS = 1_000_000
#: The bits of ``monotonically_increasing_id`` that hold the row in its partition.
ROW_BITS = 33


def surrogate_key(df: DataFrame, order_cols: Sequence[str], key_name: str, above=None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with a BIGINT ``key_name`` column numbering rows 1..n by ``order_cols``, or from ``above`` + 1.

    Callers make ``order_cols`` unique (add tie-breakers) when the numbering
    must be reproducible.
    """
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    rows = scratch_table(df, "numbering-input")
    ranges = max(1, -(-rows.count() // range_rows))  # the count comes from the files' footers
    dealt = rows.repartitionByRange(ranges, *order) if ranges > 1 else rows.coalesce(1)
    placed = dealt.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    if ranges > 1:                       # one partition of written rows has the same places whenever it is read
        placed = scratch_table(placed, "numbering")
    part, row = F.shiftright("_place", ROW_BITS), F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    key = row + 1 + (F.lit(0) if above is None else above)
    if ranges > 1:
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
        counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
        offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
        placed, key = placed.join(offsets, part == F.col("_part")), key + F.col("_before")
    return placed.withColumn(key_name, key.cast("bigint")).drop("_part", "_before", "_place")
