"""Contract checks of written tables, each one distributed aggregate.

Parquet readers report every column as nullable, so the NOT NULL columns of
the star schema are verified by counting NULLs; surrogate keys are verified
unique and dense (1..n) by comparing count, distinct count, min and max.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(AssertionError):
    pass


def null_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    cols = list(columns)
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def assert_not_null(df: DataFrame, schema: T.StructType) -> None:
    """Fail when a column declared NOT NULL in ``schema`` holds NULLs."""
    required = [f.name for f in schema.fields if not f.nullable and f.name in df.columns]
    bad = {c: n for c, n in null_counts(df, required).items() if n}
    if bad:
        raise ContractError(f"NULLs in NOT NULL columns: {bad}")


def key_profile(df: DataFrame, key: str) -> dict:
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct"),
                 F.min(key).alias("min"), F.max(key).alias("max")).first()
    return row.asDict()


def assert_dense_key(df: DataFrame, key: str) -> None:
    """Fail unless ``key`` numbers the rows 1..n without gaps or repeats."""
    p = key_profile(df, key)
    if p["rows"] and not (p["distinct"] == p["rows"] and p["min"] == 1 and p["max"] == p["rows"]):
        raise ContractError(f"{key} is not dense and unique: {p}")


def assert_unique(df: DataFrame, key: str) -> None:
    p = key_profile(df, key)
    if p["distinct"] != p["rows"]:
        raise ContractError(f"{key} is not unique: {p}")
