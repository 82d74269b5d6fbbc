"""Slowly changing dimensions, type 2: a dimension row per version of an entity.

``merge_versions`` brings a state of the master into a dimension: entities whose
tracked attributes differ (told by a hash of them) get a new version from the state's
date on, and the version before is closed the day before; new entities get a first
version; entities missing from the state stay as they are. A state brought in again
changes nothing, and a second change on the day a version began replaces that
version instead of leaving an empty interval.

``version_at`` finds the version of a date. An entity's first version also covers the
days before it began, so that early facts find their entity.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.surrogate import surrogate_key


@dataclass(frozen=True)
class Dimension:
    """The columns of a type-2 dimension: natural key, surrogate key, tracked attributes; the rest is overwritten (type 1)."""
    entity: str
    surrogate: str
    tracked: tuple[str, ...]
    valid_from: str = "valid_from"
    valid_to: str = "valid_to"
    is_current: str = "is_current"


def state_hash(columns: Sequence[str], prefix: str = "") -> F.Column:
    """One value for the tracked attributes; nulls count as values (JSON leaves no two states alike)."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"{prefix}{c}").cast("string").alias(c) for c in columns]),
                            {"ignoreNullFields": "false"}), 256)


def changes(current: DataFrame, master: DataFrame, d: Dimension) -> DataFrame:
    """The master rows that are new (``_known`` null) or differ from their current version, with that version's start."""
    now = current.filter(F.col(d.is_current)).select(
        F.col(d.entity).alias("_entity"), state_hash(d.tracked).alias("_hash"), F.col(d.valid_from).alias("_since"), F.lit(True).alias("_known"))
    return (master.join(now, F.col(d.entity) == F.col("_entity"), "left")
            .filter(F.col("_known").isNull() | (F.col("_hash") != state_hash(d.tracked))).drop("_entity", "_hash"))


def merge_versions(current: DataFrame, master: DataFrame, as_of: dt.date, d: Dimension, first_from: str | None = None) -> DataFrame:
    """The dimension after bringing in the state ``master`` of the day ``as_of``.

    ``master`` has the dimension's columns but for surrogate key and validity, one row per
    entity. A new entity is valid from its column ``first_from`` (or from ``as_of``).
    A change dated before the current version began is not brought in: states come in
    the order of their days. New surrogate keys follow the largest one."""
    day = F.lit(as_of).cast("date")
    columns = current.columns
    found = changes(current, master, d).filter(F.col("_known").isNull() | (F.col("_since") <= day))
    start = day if first_from is None else F.when(F.col("_known").isNull(), F.col(first_from)).otherwise(day)
    replaced = F.coalesce(F.col("_since") == day, F.lit(False))     # began today: the version is replaced, its key stays
    top = current.agg(F.coalesce(F.max(d.surrogate), F.lit(0))).first()[0]
    opened = surrogate_key(found.filter(~replaced), [d.entity], d.surrogate, above=F.lit(top))
    opened = opened.withColumns({d.valid_from: start, d.valid_to: F.lit(None).cast("date"), d.is_current: F.lit(True)}).select(columns)
    touched = found.select(F.col(d.entity).alias("_entity"), replaced.alias("_replaced"))
    marked = current.join(touched, (F.col(d.entity) == F.col("_entity")) & F.col(d.is_current), "left")
    kept = marked.filter(F.col("_entity").isNull()).select(columns)
    closed = (marked.filter(~F.col("_replaced"))
              .withColumns({d.valid_to: F.date_sub(day, 1), d.is_current: F.lit(False)}).select(columns))
    again = marked.filter("_replaced").select("_entity", F.col(d.surrogate).alias("_key"), F.col(d.valid_from).alias("_from"))
    fresh = [F.col("_key").alias(c) if c == d.surrogate else F.col("_from").alias(c) if c == d.valid_from
             else F.lit(None).cast("date").alias(c) if c == d.valid_to else F.lit(True).alias(c) if c == d.is_current else F.col(c) for c in columns]
    rewritten = found.filter(replaced).join(again, F.col(d.entity) == F.col("_entity")).select(fresh)
    return kept.unionByName(closed).unionByName(rewritten).unionByName(opened)


def version_at(rows: DataFrame, dimension: DataFrame, day: str, d: Dimension, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with ``columns`` of the version of their entity that is valid on ``day``."""
    by_start = Window.partitionBy(d.entity).orderBy(d.valid_from, d.surrogate)
    versions = dimension.select(F.col(d.entity).alias("_entity"), *[c for c in columns if c != d.entity],
                                F.when(F.row_number().over(by_start) > 1, F.col(d.valid_from)).alias("_from"), F.col(d.valid_to).alias("_to"))
    inside = ((F.col("_from").isNull() | (F.col(day) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(day) <= F.col("_to"))))
    return rows.join(versions, (F.col(d.entity) == F.col("_entity")) & inside, how).drop("_entity", "_from", "_to")


def overlaps(dimension: DataFrame, d: Dimension) -> DataFrame:
    """Versions that begin before the one before them has ended, or follow an open one; none in a sound dimension."""
    by_start = Window.partitionBy(d.entity).orderBy(d.valid_from, d.surrogate)
    before = F.lag(F.struct(F.col(d.valid_to).alias("to"), F.lit(True).alias("there"))).over(by_start)
    return (dimension.withColumn("_before", before)
            .filter(F.col("_before.there") & (F.col("_before.to").isNull() | (F.col("_before.to") >= F.col(d.valid_from)))).drop("_before"))
