"""A join whose hot keys are split: frequent keys go through a salted join, all others through the plain one.

A bucketed layout joins without a shuffle, so adaptive execution has nothing to split
when one key holds a bucket's worth of rows. Here a frequent-items sketch (one pass over
the key column, mergeable, a bounded number of counters) names the keys that may be
hot; their exact counts are taken, and each hot key's rows are dealt over parts by a hash of
another column, its partners copied to the parts. The other rows keep their bucketed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch: a key with more than 1/COUNTERS of the rows cannot escape it.
COUNTERS = 4096
#: Hot keys that are split at most; their list is sent with the plan.
MOST = 512


def hot_keys(rows: DataFrame, key: str, part_rows: int, counters: int = COUNTERS) -> dict:
    """The keys with more than ``part_rows`` rows, and their numbers of rows (null is no key of a join)."""
    sketch = rows.filter(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {min(MOST, counters)}, {counters})").alias("top")).first()["top"] or []
    likely = [r["item"] for r in sketch if r["count"] > part_rows]       # never less than the true count
    if not likely:
        return {}
    exact = rows.filter(F.col(key).isin(likely)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part_rows)
    return {r[key]: r["n"] for r in exact.collect()}


def split_join(rows: DataFrame, partners: DataFrame, key: str, spread_by: str, part_rows: int = 1_000_000) -> DataFrame:
    """``rows`` ⋈ ``partners`` on ``key`` (inner), no part of a key larger than about ``part_rows`` rows.

    ``spread_by`` is a column of ``rows`` that tells rows of one key apart."""
    hot = hot_keys(rows, key, part_rows)
    if not hot:
        return rows.join(partners, key)
    is_hot = F.col(key).isin(list(hot))
    parts = F.coalesce(F.create_map(*[F.lit(x) for k, n in hot.items() for x in (k, -(-n // part_rows))])[F.col(key)], F.lit(1))
    dealt = rows.filter(is_hot).withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    copied = partners.filter(is_hot).withColumn("_part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    # Dealt by key and part, not by key: the skew is gone before the shuffle.
    split = dealt.join(copied.hint("shuffle_hash"), [key, "_part"]).drop("_part")
    plain = rows.filter(~is_hot | F.col(key).isNull()).join(partners.filter(~is_hot), key)
    return plain.unionByName(split)
