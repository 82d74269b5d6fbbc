"""Run every job with Spark's event log on, then report shuffle balance.

Usage: python tools/skew_report.py SF_DIR SCRATCH_DIR [job ...]

For each job, over its stages that read at least MIN_RECORDS shuffle records,
prints the largest share of a stage's records read by a single task. With N
shuffle partitions an even spread is about 1/N; a hot key sent whole to one
task shows up as a share of a third or more.
"""

from __future__ import annotations

import glob
import json
import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.registry import JOBS  # noqa: E402
from shelfspark.session import local_session  # noqa: E402
from shelfspark.sources.raw import RawTables  # noqa: E402

MIN_RECORDS = 50_000


def main(sf_dir: str, scratch: str, names: list[str]) -> None:
    logs = f"{scratch}/eventlog"
    os.makedirs(logs, exist_ok=True)
    spark = local_session(cores=8, shuffle_partitions=16, app="shelfspark-skew",
                          extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logs,
                                      "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
                                      "spark.sql.warehouse.dir": f"{scratch}/warehouse",
                                      # show the raw hash spread (no merging of small partitions) and let
                                      # AQE treat a partition as skewed at test sizes as it would at TB sizes
                                      "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                      "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
                                      "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                                      "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
                                      # many map tasks, as input splits would be at scale
                                      "spark.sql.files.maxPartitionBytes": "256k"})
    t = RawTables.from_driver(spark, sf_dir).land(f"{scratch}/raw")
    sc = spark.sparkContext
    for name in names or list(JOBS):
        sc.setJobDescription(name)
        JOBS[name](t).write.format("noop").mode("overwrite").save()
    sc.setJobDescription(None)
    spark.stop()

    stage_job, task_records = {}, defaultdict(list)
    for path in sorted(glob.glob(f"{logs}/**/*", recursive=True)):
        if os.path.isdir(path) or path.endswith((".inprogress.crc", ".crc")) or "appstatus" in path:
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
                    recs = m.get("Total Records Read", 0)
                    task_records[ev["Stage ID"]].append(recs)
    worst = {}
    for sid, recs in task_records.items():
        total = sum(recs)
        job = stage_job.get(sid)
        if job is None or total < MIN_RECORDS:
            continue
        share = max(recs) / total
        if share > worst.get(job, (0, 0, 0))[0]:
            worst[job] = (share, total, len(recs))
    for job in names or list(JOBS):
        share, total, ntasks = worst.get(job, (0, 0, 0))
        print(f"{job:30s} max task share {share:6.1%} of {total:9d} shuffle records over {ntasks:3d} tasks")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], sys.argv[3:])
