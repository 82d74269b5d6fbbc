from shelfspark.plans import reports
from tests.fixtures import D, item, product, store, tables, tx, vendor


def _sales(spec):
    """spec: (tid, store, date, item_id, qty, price[, promo]) → transactions and items, one line each."""
    txs, items = [], []
    for s in spec:
        tid, st, date, item_id, qty, price = s[:6]
        promo = s[6] if len(s) > 6 else False
        txs.append(tx(tid, store_id=st, date=date, total=qty * price))
        items.append(item(f"{tid}-1", tid, item_id=item_id, qty=qty, price=price, promo=promo))
    return txs, items


def test_comparable_sales_growth_rank_and_eligibility(spark):
    stores = [store("S1", country="CR"), store("S2", country="GT"), store("S3", country="CR"),
              store("S4", opening="2024-05-30", fmt="F2"),       # exactly 13 months before the last sale
              store("S5", opening="2024-06-01", fmt="F2"),       # too recent
              store("S6")]                                       # only one year of sales
    txs, items = _sales([
        ("T1", "S1", "2024-02-01", "I1", 1, 100.0), ("T2", "S1", "2025-06-30", "I1", 1, 150.0),
        ("T3", "S2", "2024-02-01", "I1", 1, 200.0), ("T4", "S2", "2025-02-01", "I1", 1, 300.0),
        ("T5", "S3", "2024-02-01", "I1", 1, 100.0), ("T6", "S3", "2025-02-01", "I1", 1, 120.0),
        ("T7", "S4", "2024-06-01", "I1", 1, 100.0), ("T8", "S4", "2025-02-01", "I1", 1, 90.0),
        ("T9", "S5", "2024-06-02", "I1", 1, 100.0), ("T10", "S5", "2025-02-01", "I1", 1, 90.0),
        ("T11", "S6", "2025-02-01", "I1", 1, 90.0),
        ("T12", "S1", "2024-07-01", "I1", 1, 999.0),             # second half: not compared
    ])
    out = reports.comparable_sales(tables(spark, txs, items, stores=stores)).collect()
    got = [(r["store_id"], r["gmv_ene_jun_prev"], r["gmv_ene_jun_last"], r["POR_comp_sales_growth"],
            r["ranking_dentro_formato"]) for r in out]
    assert got == [("S1", 100.0, 150.0, 50.0, 1), ("S3", 100.0, 120.0, 20.0, 3), ("S4", 100.0, 90.0, -10.0, 1),
                   ("S2", 200.0, 300.0, 50.0, 1)]


def test_productivity_p25_boundary_is_low(spark):
    stores = [store(f"S{i}", size=100) for i in range(1, 6)]
    txs, items = _sales([(f"T{i}", f"S{i}", "2024-03-01", "I1", 1, 100.0 * i) for i in range(1, 6)])
    out = {r["store_id"]: r for r in reports.productivity_per_sqm(tables(spark, txs, items, stores=stores)).collect()}
    assert [out[f"S{i}"]["estado_rendimiento"] for i in range(1, 6)] == \
        ["BAJO_RENDIMIENTO", "BAJO_RENDIMIENTO", "NORMAL", "NORMAL", "NORMAL"]
    assert out["S5"]["ranking_formato"] == 1 and out["S5"]["gmv_por_m2"] == 5.0
    assert out["S1"]["transacciones_por_m2"] == 0.01 and out["S3"]["ticket_promedio"] == 300.0


def test_cohorts_month_boundaries_size_and_nulls(spark):
    stores = [store("S1"), store("S2", opening="2024-06-01")]
    txs = [tx("T1", date="2024-01-31", loyal=True, customer="C1", total=10.0),
           tx("T2", date="2024-02-01", loyal=True, customer="C1", total=30.0),
           tx("T3", store_id="S2", date="2024-01-15", loyal=True, customer="C2", total=5.0)]
    items = [item("a", "T1", price=10.0), item("b", "T2", price=15.0, qty=2), item("c", "T3", price=5.0)]
    r = reports.loyalty_cohorts(tables(spark, txs, items, stores=stores)).collect()
    assert len(r) == 1
    r = r[0].asDict()
    assert r["cohort_month"] == "2024-01" and r["cohort_size"] == 2
    assert r["POR_retention_mes_1"] == 50.0 and r["ticket_mes_1"] == 30.0
    assert r["POR_retention_mes_2"] is None and r["ticket_mes_6"] is None


def test_gmroi_velocity_and_zero_cost(spark):
    products = [product("I1", vendor="V1", category="C1", cost=5.0), product("I3", vendor="V1", category="C1", cost=8.0),
                product("I2", vendor="V2", category="C2", cost=0.0)]
    txs, items = _sales([("T1", "S1", "2024-03-01", "I1", 2, 10.0), ("T2", "S1", "2024-03-03", "I3", 1, 10.0),
                         ("T3", "S1", "2024-03-01", "I2", 1, 10.0), ("T4", "S1", "2024-03-05", "I2", 1, 10.0)])
    t = tables(spark, txs, items, products=products, vendors=[vendor("V1"), vendor("V2")])
    got = [tuple(r) for r in reports.gmroi_by_vendor_category(t).collect()]
    assert got == [("V2", "V2", "C2", 20.0, 0.0, 20.0, None, 1, 0.5, "OK"),
                   ("V1", "V1", "C1", 30.0, 18.0, 12.0, 0.6667, 2, 1.5, "GMROI_BAJO")]


def test_gmroi_one_day_vendor_has_null_velocity(spark):
    txs, items = _sales([("T1", "S1", "2024-03-01", "I1", 2, 10.0)])
    r = reports.gmroi_by_vendor_category(tables(spark, txs, items)).first()
    assert r["velocidad_venta_unidades_dia"] is None and r["gmroi"] == 1.0 and r["estado_gmroi"] == "OK"


def test_stockouts_follow_the_code_threshold(spark):
    i1 = ["2024-03-01", "2024-03-02", "2024-03-03", "2024-03-06", "2024-03-07", "2024-03-09", "2024-03-10"]
    i2 = ["2024-03-01", "2024-03-06", "2024-03-07", "2024-03-08", "2024-03-09", "2024-03-10"]
    spec = [(f"A{k}", "S1", d, "I1", 1, 10.0) for k, d in enumerate(i1)] + \
           [(f"B{k}", "S1", d, "I2", 1, 10.0) for k, d in enumerate(i2)]
    txs, items = _sales(spec)
    t = tables(spark, txs, items, products=[product("I1"), product("I2")])
    got = [tuple(r) for r in reports.stockout_gaps(t).collect()]
    assert got == [("S1", "I1", "name I1", "C1", D("2024-03-03"), D("2024-03-06"), 3, 1.0, 20.0)]


def test_promotion_flag_is_per_basket_and_ignores_zero_price(spark):
    products = [product("I1", category="C1"), product("I2", category="C2"), product("I3", category="C1")]
    txs = [tx("T1", total=45.0), tx("T2", total=15.0), tx("T3", total=10.0)]
    items = [item("a", "T1", "I1", qty=2, price=20.0, promo=True), item("b", "T1", "I2", qty=1, price=5.0),
             item("c", "T2", "I2", qty=3, price=5.0),
             item("d", "T3", "I1", qty=1, price=10.0), item("e", "T3", "I3", qty=1, price=0.0, promo=True)]
    out = {r["category"]: r.asDict() for r in reports.promotion_impact(tables(spark, txs, items, products=products)).collect()}
    c1, c2 = out["C1"], out["C2"]
    assert (c1["ticket_sin_promo"], c1["ticket_con_promo"], c1["num_tx_sin_promo"], c1["num_tx_con_promo"]) == (10.0, 40.0, 1, 1)
    assert (c1["POR_lift_ticket"], c1["POR_lift_unidades"], c1["diferencia_ticket"]) == (300.0, 100.0, 30.0)
    assert (c2["ticket_sin_promo"], c2["ticket_con_promo"], c2["POR_lift_ticket"]) == (15.0, 5.0, -66.67)


def test_refresh_from_shared_sales_equals_each_report(spark, scratch):
    from shelfspark.plans.daily import refresh_reports
    from shelfspark.sources.raw import RawTables
    t = RawTables.from_driver(spark, "/root/testdata/sf0.001")
    out = refresh_reports(t, f"{scratch}/reports")
    for name, job in reports.REPORTS.items():
        assert sorted(map(tuple, out[name].collect())) == sorted(map(tuple, job(t).collect())), name
