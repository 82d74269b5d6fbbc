"""Every job of the library (the training-data queries have their own tests) against its independent DuckDB statement, on the
smallest driver tables (the full sf0.01 comparison is ``python -m tests.oracle_harness``)."""

import pytest

from __spark_entry__ import oracle_sql, queries
from shelfspark.registry import JOBS
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job_matches_oracle(spark, con, name):
    assert name in oracle_sql(), f"{name} has no oracle statement"
    r = compare(spark, name, SF, con)
    assert r.get("match"), r


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns[:4] == ["country", "format", "store_id", "store_name"]
    assert df.count() >= 0


#: Jobs that are several whole runs; their types are compared with their values above.
SEVERAL_RUNS = {"p5_fact_after_increments", "b145_kept_reports", "p2_silent_stores_stream"}
SPARK_TO_DUCK = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def test_result_types_agree_with_the_oracle(spark, con):
    """Column names and types of every job equal those of its SQL statement."""
    bad = {}
    for name in sorted(JOBS.keys() - SEVERAL_RUNS):
        sql = oracle_sql()[name]
        duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                       for f in queries()[name](spark, SF).schema.fields}
        if spark_types != duck_types:
            bad[name] = (spark_types, duck_types)
    assert not bad, bad
