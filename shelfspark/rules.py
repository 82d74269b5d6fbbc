"""Business parameters of the jobs.

Every literal the analyses depend on lives here so a job can be re-run with
other thresholds, periods or labels without editing its code. ``None`` means
"derive from the data" (comparison years, run date, orphan vendors,
contaminated stores).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    # The defaults below are the thresholds, periods, labels and
    # keys of the analyses as specified (status labels, 1-cent tolerance,
    # 7-day freshness gap, 13-month comparability, January–June comparison,
    # 3-month window, 25th percentile, cohort months 1/2/3/6, GMROI floor 1,
    # 3-day stock-out gap over 7 selling days, sentinel vendor key 9999,
    # 48-hour late window, 2-day silence alert).
    # shared sales filter
    completed_status: str = "COMPLETED"
    returned_status: str = "RETURNED"
    # audits
    reconciliation_tolerance: float = 0.01      # header vs lines, A2
    freshness_gap_days: int = 7                 # A6
    # B1 comparable sales
    comparable_months: int = 13
    comp_first_month: int = 1
    comp_last_month: int = 6
    comp_years: tuple[int, int] | None = None   # None: year before the last sale, year of it
    # B2 productivity
    recent_months: int = 3
    low_percentile: float = 0.25
    # B3 cohorts
    cohort_months: tuple[int, ...] = (1, 2, 3, 6)
    # B4 GMROI
    gmroi_floor: float = 1.0
    excluded_vendors: tuple[str, ...] | None = None  # None: vendors missing from the master
    # B5 stock-outs
    stockout_gap_days: int = 3
    stockout_min_selling_days: int = 7
    # star schema
    calendar_start: dt.date | None = None        # None: first sale date
    unknown_vendor_key: int = 9999
    contaminated_stores: tuple[str, ...] | None = None  # None: stores in more than one variant
    customer_salt: str = ""
    # pipeline
    run_date: dt.date | None = None              # None: the day after the last sale
    late_window_days: int = 2
    silent_store_days: int = 2
    idle_item_days: int = 30
    correction_days: int | None = None           # None: a correction may move a sale to any date


DEFAULT_RULES = Rules()
