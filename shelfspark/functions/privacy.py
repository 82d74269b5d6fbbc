"""Pseudonymisation of customer identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pseudonymise(customer_id, salt: str = "") -> Column:
    """Lower-case hex SHA-256 of ``customer_id || salt``; NULL stays NULL.

    An empty salt gives the plain hash of the id. The same salt must be used
    wherever hashed ids are joined (customer dimension and sales fact).
    """
    c = F.col(customer_id) if isinstance(customer_id, str) else customer_id
    if salt:
        c = F.concat(c, F.lit(salt))
    return F.sha2(c, 256)
