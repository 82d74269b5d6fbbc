"""Calendar helpers shared by reports and the star schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_index(d) -> Column:
    """Months since year 0: differences count month boundaries crossed
    (SQL ``DATE_DIFF(a, b, MONTH)``), unlike Spark's whole-month ``months_between``."""
    d = _c(d)
    return (F.year(d) * 12 + F.month(d)).cast("bigint")


def month_start(d) -> Column:
    """DATE_TRUNC(d, MONTH) as a DATE."""
    return F.trunc(_c(d), "MONTH")


def date_key(d) -> Column:
    """YYYYMMDD integer surrogate of a date."""
    d = _c(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("bigint")


def months_before(d, n: int) -> Column:
    """d - INTERVAL n MONTH, clamped to month end like SQL engines do."""
    return F.add_months(_c(d), -n)
