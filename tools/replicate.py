"""Build an N-times larger copy of the driver tables for scaling runs.

Usage: python tools/replicate.py SRC_DIR DST_DIR N

Copy i shifts order, customer and part keys by i × (max key + 1), so every copy
is a disjoint set of customers, orders and lines with the same distributions;
stores, regions and suppliers are shared (they are master data, not volume).
Written with Spark; the result has the same file layout as the source.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shelfspark.session import local_session  # noqa: E402

SHIFTS = {
    "orders": {"o_orderkey": "orders.o_orderkey", "o_custkey": "customer.c_custkey"},
    "lineitem": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey"},
    "customer": {"c_custkey": "customer.c_custkey"},
    "part": {"p_partkey": "part.p_partkey"},
}


def main(src: str, dst: str, n: int) -> None:
    spark = local_session(cores=8, shuffle_partitions=16)
    src, dst = src.rstrip("/"), dst.rstrip("/")
    spans = {}
    for key in ("orders.o_orderkey", "customer.c_custkey", "part.p_partkey"):
        table, col = key.split(".")
        spans[key] = spark.read.parquet(f"{src}/{table}.parquet").agg(F.max(col)).first()[0] + 1
    for name in sorted(os.listdir(src)):
        table = name.removesuffix(".parquet")
        df = spark.read.parquet(f"{src}/{name}")
        if table in SHIFTS:
            df = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))   # n copies
            for col, span in SHIFTS[table].items():
                df = df.withColumn(col, (F.col(col) + F.col("_copy") * spans[span]).cast(df.schema[col].dataType))
            df = df.drop("_copy")
        df.write.mode("overwrite").parquet(f"{dst}/{name}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]))
