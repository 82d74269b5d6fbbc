"""Physical-plan checks: the properties the jobs rely on at scale."""

import contextlib
import io

import pytest

from shelfspark.plans import audit, reports
from shelfspark.plans.star import Star
from shelfspark.sources.raw import RawTables


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landed"))
    return RawTables.from_driver(spark, "/root/testdata/sf0.001").land(base)


def test_filters_and_columns_reach_the_scan(landed):
    p = plan(reports.comparable_sales(landed))
    assert "GreaterThan(total_amount,0.0)" in p
    assert "EqualTo(status,COMPLETED)" in p and "GreaterThan(unit_price,0.0)" in p
    # the items scan reads only the columns the report needs
    assert "ReadSchema: struct<transaction_id:string,quantity:bigint,unit_price:double>" in p


def test_master_tables_are_broadcast(landed):
    p = plan(reports.comparable_sales(landed))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_orphan_checks_plan_as_anti_joins(landed):
    assert "LeftAnti" in plan(audit.orphan_stores(landed))
    assert "LeftAnti" in plan(audit.orphan_vendors(landed))


def test_customer_dimension_has_no_single_partition_step(landed, tmp_path):
    # As in build_star: the (small, measured) store dimension is written first.
    star = Star(landed)
    star.dim_store.write.parquet(str(tmp_path / "dim_store"))
    star.__dict__["dim_store"] = landed.spark.read.parquet(str(tmp_path / "dim_store"))
    assert "SinglePartition" not in plan(star.dim_customer)


def test_stockouts_pre_aggregate_before_the_window(landed):
    p = plan(reports.stockout_gaps(landed))
    assert p.index("Window") < p.rindex("HashAggregate")   # window sits above the daily aggregate


def test_dedup_aggregates_map_side(landed):
    from shelfspark.plans import pipeline
    t = RawTables.from_driver(landed.spark, "/root/testdata/sf0.001")
    p = plan(pipeline.latest_versions(t))
    # the partial limit runs before the shuffle
    assert p.index("WindowGroupLimit") < p.index("Exchange") or "Partial" in p
    assert "Partial" in p


def test_bucketed_layout_joins_without_exchange_and_same_results(spark, tmp_path):
    from pyspark.sql import functions as F  # noqa: F401
    src = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shelf_test LOCATION '{tmp_path}/db'")
    bucketed = src.land_bucketed("shelf_test", buckets=4)
    p = plan(audit.header_line_reconciliation(bucketed))
    assert "Exchange hashpartitioning" not in p
    p = plan(reports.gmroi_by_vendor_category(bucketed))
    sales_join = p[p.index("SortMergeJoin"):] if "SortMergeJoin" in p else ""
    assert "SortMergeJoin" not in p or "Exchange hashpartitioning(transaction_id" not in sales_join
    for job in (reports.stockout_gaps, reports.promotion_impact, audit.header_line_reconciliation):
        a = sorted(map(tuple, job(bucketed).collect()), key=repr)
        b = sorted(map(tuple, job(src).collect()), key=repr)
        assert a == b


def test_layout_is_the_callers_choice(spark, tmp_path):
    from tests.fixtures import item, tables, tx
    hot = tables(spark, transactions=[tx("T1"), tx("T2")],
                 items=[item(f"a{i}", "T1") for i in range(30)] + [item("b", "T2")])
    landed = hot.land_bucketed("shelf_plain", buckets=4, location=str(tmp_path / "db"), bucketed=())
    assert spark.sql("DESCRIBE TABLE EXTENDED shelf_plain.transaction_items").filter(
        "col_name = 'Num Buckets'").count() == 0
    assert landed.transaction_items.count() == 31


def test_baskets_are_summed_before_they_meet_their_header(spark):
    """B2 and B6 bring a basket of any size to the join as one row (per item)."""
    from tests.fixtures import item, product, tables, tx
    t = tables(spark, transactions=[tx("T1"), tx("T2")], products=[product("I1")],
               items=[item(f"h{i}", "T1") for i in range(50)] + [item("n", "T2")])
    for job in (reports.productivity_per_sqm, reports.promotion_impact):
        text = job(t)._jdf.queryExecution().optimizedPlan().toString()
        scans = text[:text.index("transaction_item_id")] if "transaction_item_id" in text else text
        assert "Aggregate [transaction_id" in scans
    assert reports.basket_sales(t, "item_id").count() == 2


def test_hot_transaction_is_split_by_adaptive_skew_join(spark, tmp_path):
    """One basket holds most lines of the fact build; AQE splits its partition."""
    from pyspark.sql import functions as F
    from shelfspark.plans.star import Star
    from tests.fixtures import item, product, tables, tx
    base = tables(spark, transactions=[tx(f"T{i}") for i in range(200)],
                  items=[item(f"h{i}", "T0", price=1.0 + i % 7) for i in range(6000)]
                  + [item(f"n{i}", f"T{i % 200}") for i in range(3000)], products=[product("I1")])
    # Land the sales tables as many files, so the hot basket's lines come from many map tasks.
    for name in ("transactions", "transaction_items"):
        base.table(name).repartition(16, F.rand(7)).write.parquet(str(tmp_path / name))
    t = tables(spark, products=[product("I1")])
    t.transactions = spark.read.parquet(str(tmp_path / "transactions"))
    t.transaction_items = spark.read.parquet(str(tmp_path / "transaction_items"))
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        fact = Star(t).fact_sales
        assert len(fact.collect()) == 9000
        assert "skew=true" in plan(fact)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
