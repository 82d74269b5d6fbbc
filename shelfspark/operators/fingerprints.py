"""Reconciliation of two tables by fingerprints, reading rows only where they differ.

A fingerprint of a set of rows is its count and two sums of row hashes, so it does not
depend on order or layout and sums of parts add up to the sum of the whole. Both tables are
compared per part (a partition column); parts that differ are compared per bucket of the key,
and only the rows of differing buckets are compared themselves. ``kept`` fingerprints of
an earlier pass can stand in for either table on the first level.

The tables are read up to three times: callers write down what they would have to derive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.session import scratch_table

SUMS = ("n", "s1", "s2")
BUCKETS = 64


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Nulls are told from values: a null is skipped by the hash, so its place is hashed as well."""
    return F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns])


def fingerprints(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by``, and count and hash sums of the rows' ``columns``."""
    def total(seed: int) -> Column:
        return F.sum(row_hash(columns, seed).cast("decimal(38,0)"))

    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total(1).alias("s1"), total(2).alias("s2"))


def unequal(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ``by`` whose fingerprints differ or that one side lacks."""
    left = a.select(*by, F.struct(*SUMS).alias("_a"))
    right = b.select(*by, F.struct(*SUMS).alias("_b"))
    return left.join(right, list(by), "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*by)


def differences(a: DataFrame, b: DataFrame, key: str, part: str, columns: Sequence[str], buckets: int = BUCKETS,
                kept_a: DataFrame | None = None, kept_b: DataFrame | None = None) -> DataFrame:
    """Keys whose rows (``columns``, ``part`` included) are not the same on both sides: ``part``, ``key``, ``n_a``, ``n_b``
    and ``same`` (rows found on both). A null part is a part of its own."""
    columns = list(dict.fromkeys([part, key, *columns]))
    parts = unequal(fingerprints(a, [part], columns) if kept_a is None else kept_a,
                    fingerprints(b, [part], columns) if kept_b is None else kept_b, [part])
    wanted = [r[0] for r in parts.collect()]             # partition values
    in_parts = F.col(part).isin([w for w in wanted if w is not None]) | (F.col(part).isNull() if None in wanted else F.lit(False))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket")
    a, b = (x.filter(in_parts).select(*columns, bucket) for x in (a, b))
    found = unequal(fingerprints(a, [part, "_bucket"], columns), fingerprints(b, [part, "_bucket"], columns), [part, "_bucket"])
    # At most a row per part and bucket: written, its size is known, so the rows stay where they are.
    found = scratch_table(found.select(F.col(part).alias("_part"), F.col("_bucket").alias("_b")), "differing-buckets")
    here = F.col(part).eqNullSafe(F.col("_part")) & (F.col("_bucket") == F.col("_b"))
    both = None
    for rows, side in ((a, "a"), (b, "b")):
        mine = rows.join(found, here, "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        mine = mine.withColumns({"n_a": F.col("n") if side == "a" else F.lit(0), "n_b": F.col("n") if side == "b" else F.lit(0)}).drop("n")
        both = mine if both is None else both.unionByName(mine)
    per_row = both.groupBy(*columns).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    return (per_row.groupBy(part, key).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum(F.least("n_a", "n_b")).alias("same"))
            .filter((F.col("n_a") != F.col("same")) | (F.col("n_b") != F.col("same"))))
