"""Run named jobs and write their results as Parquet.

    spark-submit --py-files shelfspark.zip shelfspark/__main__.py \\
        --source parquet --path s3://…/raw --out s3://…/reports b1_comparable_sales b5_stockout_gaps

``--source`` is ``parquet`` (landed folders), ``csv`` (exports with headers),
``catalog`` (a database, e.g. the bucketed layout) or ``driver`` (TPC-H-style
test tables). ``--star`` builds and writes the whole star schema instead.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from shelfspark.registry import JOBS
from shelfspark.sources.raw import RawTables


def load(spark: SparkSession, source: str, path: str) -> RawTables:
    return {"parquet": RawTables.from_parquet, "csv": RawTables.from_csv,
            "catalog": RawTables.from_catalog, "driver": RawTables.from_driver}[source](spark, path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="shelfspark")
    ap.add_argument("--source", choices=["parquet", "csv", "catalog", "driver"], default="parquet")
    ap.add_argument("--path", required=True, help="folder of the raw tables, or the database name")
    ap.add_argument("--out", required=True, help="output folder (one sub-folder per job)")
    ap.add_argument("--star", action="store_true", help="build the star schema under --out")
    ap.add_argument("jobs", nargs="*", help=f"job names (default: all {len(JOBS)})")
    args = ap.parse_args(argv)
    unknown = [j for j in args.jobs if j not in JOBS]
    if unknown:
        ap.error(f"unknown jobs: {unknown}")
    spark = SparkSession.builder.appName("shelfspark").getOrCreate()
    tables = load(spark, args.source, args.path)
    if args.star:
        from shelfspark.plans.star import build_star
        build_star(tables, args.out.rstrip("/"))
        return 0
    for name in args.jobs or list(JOBS):
        JOBS[name](tables).write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
