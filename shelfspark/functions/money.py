"""Exact money arithmetic and engine-independent rounding.

Amounts are decimals: a price is taken to four places, ``price * quantity`` and
sums stay decimals, and the sum is turned into a double once. Nothing is rounded
before it is multiplied, and a sum does not depend on the order in which
partitions are combined, so it is the same on every run and on every engine.

Rounding is half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
COUNT = "decimal(18,0)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact(amount) -> Column:
    """A money double as a decimal of four places."""
    return _c(amount).cast(MONEY)


def as_money(amount) -> Column:
    """A decimal amount as a double."""
    return _c(amount).cast("double")


def times(amount, quantity) -> Column:
    """A decimal amount, ``quantity`` times."""
    return _c(amount) * _c(quantity).cast(COUNT)


def line_amount(unit_price, quantity) -> Column:
    """``unit_price * quantity`` of one line, as a decimal."""
    return times(exact(unit_price), quantity)


def round_half_away(x, digits: int) -> Column:
    """ROUND(x, digits), half away from zero: sign(x)*floor(|x|*10^d + 0.5)/10^d."""
    x = _c(x)
    scale = 10 ** digits
    return (F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale).cast("double")


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (SQL ``x / NULLIF(y, 0)``)."""
    return _c(num) / F.nullif(_c(den), F.lit(0))
