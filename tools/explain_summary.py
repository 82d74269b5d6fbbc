"""Per-job physical plan summary, with automatic broadcasts off (as at 100 TB,
where only the measured master tables may be broadcast).

Usage: python tools/explain_summary.py SF_DIR [job ...]
Prints, per job: hash/range shuffles, broadcasts, sort-merge joins, windows,
and single-partition exchanges that carry rows (not one partial aggregate row
per task).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.registry import JOBS  # noqa: E402
from shelfspark.session import local_session  # noqa: E402
from shelfspark.sources.raw import RawTables  # noqa: E402


def summary(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    tree = buf.getvalue().split("\n\n")[0]
    simple = io.StringIO()
    with contextlib.redirect_stdout(simple):
        df.explain()
    lines = simple.getvalue().splitlines()
    # Single-partition exchanges that carry rows, i.e. not the one-row-per-task
    # partial results of a global aggregate (MAX(date) and the like).
    row_level = sum(1 for i, line in enumerate(lines)
                    if "Exchange SinglePartition" in line
                    and not any("partial_" in nxt for nxt in lines[i + 1:i + 3]))
    return {"shuffles": len(re.findall(r"\bExchange \(", tree)),
            "broadcasts": len(re.findall(r"BroadcastExchange", tree)),
            "smj": len(re.findall(r"SortMergeJoin", tree)),
            "windows": len(re.findall(r"\bWindow \(", tree)),
            "single_partition": row_level}


def main(sf_dir: str, names: list[str]) -> None:
    spark = local_session(cores=8, shuffle_partitions=16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t = RawTables.from_driver(spark, sf_dir).land(tempfile.mkdtemp(prefix="explain-", dir="/tmp"))
    print("| job | shuffles | broadcasts | sort-merge joins | windows | row-level single-partition exchanges |")
    print("|---|---|---|---|---|---|")
    for name in names or list(JOBS):
        s = summary(JOBS[name](t))
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['windows']} | "
              f"{s['single_partition']} |")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
