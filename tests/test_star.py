from pyspark.sql import functions as F

from shelfspark.plans.star import Star, build_star, fact_coverage
from shelfspark.rules import Rules
from tests.fixtures import D, item, product, promo, rows, store, tables, tx, vendor


def test_vendor_sentinel_and_orphan_products(spark):
    t = tables(spark, products=[product("I1", vendor="V1"), product("I2", vendor="VND_031"),
                                product("I3", vendor="VND_031")],
               vendors=[vendor("V1"), vendor("V2")])
    star = Star(t)
    assert rows(star.dim_vendor, "vendor_key", "vendor_id", "vendor_name", "is_valid") == \
        [(1, "V1", "V1", True), (2, "V2", "V2", True), (9999, "VND_031", "UNKNOWN", False)]
    assert rows(star.dim_product, "item_id", "vendor_key", "is_orphan_vendor") == \
        [("I1", 1, False), ("I2", 9999, True), ("I3", 9999, True)]


def test_customer_dimension_tie_break_and_hash(spark):
    stores = [store("S1", country="CR"), store("S2", country="GT")]
    txs = [tx("T2", store_id="S2", date="2024-03-01", loyal=True, customer="C1"),
           tx("T1", store_id="S1", date="2024-03-01", loyal=True, customer="C1"),
           tx("T3", store_id="S2", date="2024-04-01", loyal=True, customer="C2"),
           tx("T4", store_id="S2", date="2024-02-01", loyal=True, customer="C2", total=0.0)]
    star = Star(tables(spark, txs, stores=stores))
    got = rows(star.dim_customer, "customer_key", "first_transaction_date", "acquisition_store_key",
               "acquisition_country", "cohort_month")
    assert got == [(1, D("2024-03-01"), 1, "CR", D("2024-03-01")), (2, D("2024-04-01"), 2, "GT", D("2024-04-01"))]
    import hashlib
    assert star.dim_customer.filter("customer_key = 1").first()["customer_id_hashed"] == \
        hashlib.sha256(b"C1").hexdigest()


def test_bridge_between_is_inclusive(spark):
    txs = [tx("T1", date="2024-03-01"), tx("T2", date="2024-03-10"), tx("T3", date="2024-03-11")]
    t = tables(spark, txs, promotions=[promo("S1", start="2024-03-01", end="2024-03-10")])
    assert rows(Star(t).bridge_promotion) == [("T1", 1), ("T2", 1)]


def test_contamination_derived_from_variants(spark):
    t = tables(spark, stores=[store("S1"), store("S2")],
               promotions=[promo("S1", variant="CONTROL"), promo("S1", variant="TREATMENT"), promo("S2")])
    assert rows(Star(t).dim_promotion, "store_id", "variant", "is_contaminated") == \
        [("S1", "CONTROL", True), ("S1", "TREATMENT", True), ("S2", "CONTROL", False)]


def test_fact_flags_precedence_and_anonymous_rows(spark):
    stores = [store("S1", opening="2024-03-01")]
    txs = [tx("T1", date="2024-02-01", total=0.0),                    # three problems at once
           tx("T2", date="2024-03-05", loyal=True, customer="C1"),
           tx("T3", date="2024-03-05"),                               # anonymous
           tx("T4", date="2024-02-01")]
    items = [item("a", "T1", price=0.0, promo=False), item("b", "T2", price=10.0, qty=3),
             item("c", "T3", price=0.0, promo=False), item("d", "T4"), item("e", "T3", price=0.0, promo=True)]
    fact = Star(tables(spark, txs, items, stores=stores)).fact_sales
    got = rows(fact, "transaction_item_id", "data_quality_flag", "customer_key", "gmv", "gross_margin")
    assert got == [("a", "MONTO_INVALIDO", None, 0.0, -5.0), ("b", None, 1, 30.0, 15.0),
                   ("c", "PRECIO_CERO_SIN_PROMO", None, 0.0, -5.0), ("d", "TRAN_ANTES_APERTURA", None, 10.0, 5.0),
                   ("e", None, None, 0.0, -5.0)]


def test_clean_view_keeps_zero_price_promo_and_drops_orphan_vendors(spark):
    products = [product("I1", vendor="V1"), product("I2", vendor="VX")]
    txs = [tx("T1", date="2024-03-05")]
    items = [item("a", "T1", "I1", price=0.0, promo=True), item("b", "T1", "I2", price=5.0)]
    view = Star(tables(spark, txs, items, products=products)).clean_sales()
    assert rows(view, "transaction_item_id", "vendor_id", "fiscal_period") == [("a", "V1", "FY2024-Q1")]


def test_build_star_writes_partitioned_fact_and_keeps_every_line(spark, scratch):
    txs = [tx(f"T{i}", date=f"2024-03-0{i}", loyal=i % 2 == 0, customer=f"C{i}" if i % 2 == 0 else None)
           for i in range(1, 6)]
    items = [item(f"L{i}", f"T{i}", qty=i) for i in range(1, 6)]
    t = tables(spark, txs, items)
    out = build_star(t, f"{scratch}/star")
    fact = out["fact_sales"]
    assert fact.count() == 5
    assert fact.agg(F.sum("gmv")).first()[0] == 150.0
    assert fact_coverage(t, fact).first().asDict() == {"item_rows": 5, "fact_rows": 5, "dropped_rows": 0}
    import os
    parts = sorted(p for p in os.listdir(f"{scratch}/star/fact_sales") if p.startswith("transaction_date="))
    assert parts == [f"transaction_date=2024-03-0{i}" for i in range(1, 6)]
    assert out["view_clean_sales"].count() == 5


def test_salt_is_applied_on_both_sides(spark):
    txs = [tx("T1", loyal=True, customer="C1")]
    t = tables(spark, txs, [item("a", "T1")], rules=Rules(customer_salt="pepper"))
    star = Star(t)
    import hashlib
    assert star.dim_customer.first()["customer_id_hashed"] == hashlib.sha256(b"C1pepper").hexdigest()
    assert star.fact_sales.first()["customer_key"] == 1


def test_written_star_honours_its_contract(spark, scratch):
    import pytest as _pytest
    from shelfspark.operators.checks import ContractError, assert_dense_key, assert_not_null
    from shelfspark.sources.raw import RawTables
    from shelfspark.sources.schemas import STAR
    t = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    out = build_star(t, f"{scratch}/star")
    for name, key in [("dim_store", "store_key"), ("dim_product", "product_key"),
                      ("dim_customer", "customer_key"), ("dim_promotion", "promotion_key")]:
        assert_dense_key(out[name], key)
    for name in ("dim_date", "dim_vendor", "dim_product", "dim_store", "dim_customer", "dim_promotion",
                 "bridge_promotion", "fact_sales"):
        assert_not_null(out[name], STAR[name])
    # anonymous sales keep a NULL customer key; card holders whose id is known get one, those without id none
    fact = out["fact_sales"]
    assert fact.filter("NOT loyalty_card AND customer_key IS NOT NULL").count() == 0
    known = t.transactions.filter("customer_id IS NOT NULL").select("transaction_id").distinct()
    lost = fact.filter("loyalty_card AND customer_key IS NULL AND total_amount_reported > 0 AND status = 'COMPLETED'")
    assert lost.join(known, "transaction_id", "left_semi").count() == 0
    assert lost.join(known, "transaction_id", "left_anti").count() > 0
    # Σ fact GMV equals Σ line amounts of the lines that enter the fact
    from shelfspark.plans.star import fact_lines
    total = fact_lines(t).selectExpr("sum(CAST(unit_price AS DECIMAL(18,4)) * quantity)").first()[0]
    assert abs(fact.agg(F.sum("gmv")).first()[0] - float(total)) < 1e-6 * float(total)
    with _pytest.raises(ContractError):
        assert_dense_key(out["dim_vendor"], "vendor_key")      # sentinel keys sit above the dense range


def test_views_and_column_comments(spark, scratch):
    from shelfspark.plans.star import register_views
    txs = [tx("T1", date="2024-03-05")]
    out = build_star(tables(spark, txs, [item("a", "T1", qty=2)]), f"{scratch}/star")
    register_views(out)
    assert spark.sql("SELECT sum(gmv) FROM view_clean_sales").first()[0] == 20.0
    assert Star(tables(spark, txs)).dim_date.schema["date_key"].metadata.get("comment") == "PK surrogate YYYYMMDD"


def test_reports_on_star_use_the_view_definition(spark):
    from shelfspark.plans import reports, star_reports
    products = [product("I1", vendor="V1"), product("I2", vendor="VX"), product("I3", vendor="V1", cost=0.0)]
    txs = [tx("T1", date="2024-03-05"), tx("T2", date="2024-03-06")]
    items = [item("a", "T1", "I1", price=10.0, qty=2), item("b", "T1", "I2", price=5.0),       # orphan vendor
             item("c", "T2", "I3", price=0.0, promo=True)]                                     # free promo line
    t = tables(spark, txs, items, products=products)
    on_star = {(r["vendor_id"], r["skus_activos"]) for r in star_reports.gmroi_on_star(t).collect()}
    on_raw = {(r["vendor_id"], r["skus_activos"]) for r in reports.gmroi_by_vendor_category(t).collect()}
    assert on_star == {("V1", 2)}          # the free promo line's SKU is active on the star
    assert on_raw == {("V1", 1)}           # the reports drop every zero price


def test_command_line_runner(spark, scratch):
    from shelfspark.__main__ import main
    assert main(["--source", "driver", "--path", "/root/testdata/sf0.001", "--out", f"{scratch}/out",
                 "a1_completeness", "s8f_flag_distribution"]) == 0
    assert spark.read.parquet(f"{scratch}/out/a1_completeness").count() == 1
    flags = {r["data_quality_flag"] for r in spark.read.parquet(f"{scratch}/out/s8f_flag_distribution").collect()}
    assert None in flags and "MONTO_INVALIDO" in flags


def test_raw_views_accept_sql(spark):
    t = tables(spark, transactions=[tx("T1"), tx("T2", total=0.0)])
    t.register_views()
    assert spark.sql("SELECT count(*) FROM transactions WHERE total_amount <= 0").first()[0] == 1


def test_calendar_coverage_and_dimension_validation(spark, scratch):
    import datetime as dt
    import pytest as _pytest
    from shelfspark.operators.checks import ContractError
    from shelfspark.plans.star import uncovered_sales, validate_dimensions
    txs = [tx("T1", date="2024-03-01"), tx("T2", date="2024-03-05")]
    items = [item("a", "T1"), item("b", "T2")]
    star = Star(tables(spark, txs, items, rules=Rules(calendar_start=dt.date(2024, 3, 3))))
    assert rows(uncovered_sales(star.fact_sales, star.dim_date)) == [(D("2024-03-01"), 1)]
    bad = Star(tables(spark, txs, items, products=[product("I1", vendor=None)]))
    dims = {n: getattr(bad, n) for n in ("dim_date", "dim_vendor", "dim_product", "dim_store",
                                        "dim_customer", "dim_promotion")}
    with _pytest.raises(ContractError):
        validate_dimensions(dims)            # a product without vendor has no vendor_key


def test_rebuild_replaces_the_whole_fact(spark, scratch):
    first = tables(spark, [tx("T1", date="2024-03-01"), tx("T2", date="2024-03-02")],
                   [item("a", "T1"), item("b", "T2")])
    build_star(first, f"{scratch}/star")
    second = tables(spark, [tx("T2", date="2024-03-02")], [item("b", "T2")])
    out = build_star(second, f"{scratch}/star")
    assert rows(out["fact_sales"], "transaction_item_id") == [("b",)]      # the 03-01 partition is gone


def test_fact_with_hot_transactions_split_is_the_same(spark, scratch):
    txs = [tx(f"T{i}", loyal=True, customer=f"C{i}") for i in range(20)]
    items = [item(f"h{i}", "T0", price=1.0 + i % 7) for i in range(300)] + [item(f"n{i}", f"T{i % 20}") for i in range(60)]
    t = tables(spark, txs, items)
    want = rows(Star(t).fact_sales)
    assert rows(Star(t, part_rows=50).fact_sales) == want
    out = build_star(t, f"{scratch}/star", part_rows=50)
    assert rows(out["fact_sales"], "transaction_item_id", "customer_key") == [(r[0], r[6]) for r in want]
