"""Benchmark: every registered job at one scale factor.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value" (seconds for all jobs), "unit", "queries",
"ingest_sec" (landing the derived tables, reported apart), "sf", ...}.

Method: the retail tables are first derived from the driver's tables and
landed (timed as ``ingest``), the way raw exports sit in storage. The default
layout (BENCH_LAYOUT=bucketed) stores transactions and their items bucketed by
transaction_id, so the reports' large join needs no shuffle; BENCH_LAYOUT=plain
lands plain Parquet folders.
Each job then runs to completion over those files (a ``noop`` write executes
the whole plan without collecting results on the driver). All jobs run twice:
the first pass (reported as ``cold_queries``) includes JIT and code generation
for each new plan; the second pass is the headline, a warm JVM as in the Spark
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.registry import JOBS  # noqa: E402
from shelfspark.session import local_session  # noqa: E402
from shelfspark.sources.raw import RawTables  # noqa: E402


#: Jobs that are several whole daily runs or a drained stream.
SEVERAL_RUNS = {"p5_fact_after_increments", "b145_kept_reports", "p2_silent_stores_stream"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:] if a in JOBS]
    scratch = tempfile.mkdtemp(prefix="shelfspark-bench-", dir=os.environ.get("SHELFSPARK_SCRATCH", "/tmp"))
    partitions = int(os.environ.get("BENCH_PARTITIONS", max(2 * cpus, 8)))
    spark = local_session(cores=cpus, shuffle_partitions=partitions, driver_memory="16g", app="shelfspark-bench",
                          extra_conf={"spark.sql.warehouse.dir": f"{scratch}/warehouse"})

    t0 = time.time()
    source = RawTables.from_driver(spark, sf_dir)
    plain = source.land(f"{scratch}/raw")
    ingest_plain = time.time() - t0
    t0 = time.time()
    tables = source.land_bucketed("shelf_bench", buckets=partitions)
    ingest = time.time() - t0

    def timed_pass(tables) -> dict:
        out = {}
        for name, job in JOBS.items():
            if name in SEVERAL_RUNS or only and name not in only:
                continue         # daily runs are timed below, once
            t1 = time.time()
            job(tables).write.format("noop").mode("overwrite").save()   # plan construction included
            out[name] = round(time.time() - t1, 3)
        return out

    cold = timed_pass(plain)       # plain Parquet, first run of each plan: JIT and code generation included
    timings = timed_pass(tables)   # bucketed, warm JVM

    from shelfspark.plans import pipeline, star
    t1 = time.time()
    if not only:
        star.build_star(plain, f"{scratch}/star")
    build = time.time() - t1
    t1 = time.time()
    if not only:
        pipeline.daily_run(plain, f"{scratch}/star")
    daily = time.time() - t1
    # The next day's run over the indexed fact: corrections of the last day's lines.
    t1 = time.time()
    if not only:
        import dataclasses
        from pyspark.sql import functions as F
        last = plain.item_feed.agg(F.max("ingestion_timestamp")).first()[0]
        again = plain.item_feed.filter(F.col("ingestion_timestamp") == F.lit(last)).withColumns({
            "quantity": F.col("quantity") + 1, "ingestion_timestamp": F.col("ingestion_timestamp") + F.expr("INTERVAL 1 DAY")})
        pipeline.daily_run(dataclasses.replace(plain, item_feed=again), f"{scratch}/star")
    next_daily = time.time() - t1

    # The six reports refreshed together, sharing one written computation of the sales.
    from shelfspark.plans.daily import refresh_reports
    t2 = time.time()
    for df in refresh_reports(tables).values():
        df.write.format("noop").mode("overwrite").save()
    refresh = time.time() - t2

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_seconds_all_jobs",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "daily_refresh_sec": round(refresh, 3),
        "reports_separately_sec": round(sum(v for k, v in timings.items() if k[:2] in
                                            ("b1", "b2", "b3", "b4", "b5", "b6") and "s_" not in k[:4]), 3),
        "plain_cold_queries": cold,
        "plain_cold_sec": round(sum(cold.values()), 3),
        "plain_ingest_sec": round(ingest_plain, 3),
        "plain_cold_with_ingest_sec": round(sum(cold.values()) + ingest_plain, 3),
        "ingest_sec": round(ingest, 3),
        "build_star_sec": round(build, 3),
        "daily_run_sec": round(daily, 3),
        "next_daily_run_sec": round(next_daily, 3),
        "jobs_sec": round(sum(timings.values()), 3),
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "layout": "bucketed, warm; plain_cold: plain Parquet, first run",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
