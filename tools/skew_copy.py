"""Write a skewed copy of the driver tables: one key holds a third of the rows.

Usage: python tools/skew_copy.py SRC_DIR DST_DIR

* a third of the customers move to nation 0, so one store gets about a third
  of all transactions;
* a third of the orders move to customer 0 (a card holder), one hot customer;
* a third of the line items move to order 0, one basket with a third of all lines.
Used to check that results stay exact and no task receives a hot key whole.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shelfspark.session import local_session  # noqa: E402

def hot_keys() -> dict:
    return {
        "customer": ("c_nationkey", F.col("c_custkey") % 3 == 0, 0),
        "orders": ("o_custkey", F.col("o_orderkey") % 3 == 0, 0),
        "lineitem": ("l_orderkey", F.col("l_partkey") % 3 == 0, 0),
    }


def main(src: str, dst: str) -> None:
    spark = local_session(cores=8, shuffle_partitions=16)
    HOT = hot_keys()
    for name in sorted(os.listdir(src)):
        table = name.removesuffix(".parquet")
        df = spark.read.parquet(f"{src.rstrip('/')}/{name}")
        if table in HOT:
            col, cond, value = HOT[table]
            df = df.withColumn(col, F.when(cond, F.lit(value).cast(df.schema[col].dataType)).otherwise(F.col(col)))
        df.write.mode("overwrite").parquet(f"{dst.rstrip('/')}/{name}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
