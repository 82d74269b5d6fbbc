"""The daily report refresh: all reports from one computation of the sales.

Every report starts from the same filtered items ⋈ transactions join. A run
that refreshes them together writes that join once — the narrow item-grain
columns the reports read — to the shared checkpoint folder, then runs each
report over the written table. The large join happens once instead of once
per report, and the written table also cuts the lineage: a lost executor
re-reads files instead of recomputing the join.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame

from shelfspark.plans.common import valid_sales
from shelfspark.plans.reports import REPORTS
from shelfspark.session import scratch_path
from shelfspark.sources.raw import RawTables

SALES_COLUMNS = ("transaction_id", "item_id", "quantity", "unit_price", "was_on_promo", "line_amount",
                 "store_id", "customer_id", "loyalty_card", "transaction_date")


def with_shared_sales(t: RawTables) -> RawTables:
    """``t`` whose reports read the filtered sales from one written table."""
    path = scratch_path(t.spark, f"valid-sales-{uuid.uuid4().hex}")
    valid_sales(t).select(*SALES_COLUMNS).write.parquet(path)
    return dataclasses.replace(t, shared_sales=t.spark.read.parquet(path))


def refresh_reports(t: RawTables, out: str | None = None) -> dict[str, DataFrame]:
    """Run every report over shared sales; write each under ``out`` when given."""
    shared = with_shared_sales(t)
    results = {}
    for name, job in REPORTS.items():
        df = job(shared)
        if out:
            df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
            df = t.spark.read.parquet(f"{out.rstrip('/')}/{name}")
        results[name] = df
    return results
