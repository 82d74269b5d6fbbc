"""Name → job table used by the entry point, the bench and the tests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.plans.audit import AUDITS
from shelfspark.plans.pipeline import PIPELINE_JOBS
from shelfspark.plans.reports import REPORTS
from shelfspark.plans.scaled import SCALED_JOBS
from shelfspark.plans.star import STAR_JOBS
from shelfspark.plans.star_reports import STAR_REPORTS
from shelfspark.sources.raw import RawTables
from shelfspark.streaming.silence import STREAM_JOBS

JOBS: dict[str, Callable[[RawTables], DataFrame]] = {**REPORTS, **AUDITS, **STAR_JOBS, **STAR_REPORTS, **PIPELINE_JOBS, **SCALED_JOBS,
                                                     **STREAM_JOBS}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return JOBS[name](RawTables.from_driver(spark, sf_dir))


def as_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, spark, sf_dir)
    query.__name__ = name
    return query
