import datetime as dt

from shelfspark.plans import audit
from tests.fixtures import D, item, product, promo, rows, store, tables, tx, vendor


def test_completeness_counts_and_null_flag(spark):
    t = tables(spark, transactions=[
        tx("T1"), tx("T2"), tx("T3"),
        tx("T4", loyal=True, customer="C1"), tx("T5", loyal=True, customer="C2"),
        tx("T6", loyal=True, customer=None),
        tx("T7", loyal=None),
    ])
    r = audit.completeness(t).first().asDict()
    assert r == {"loyalty_false": 3, "loyalty_true": 3, "POR_loyalty_false": 42.9, "POR_loyalty_true": 42.9,
                 "loyalty_false_sin_id": 3, "inconsistencia_critica": 1}


def test_reconciliation_is_cent_exact_and_skips_headerless(spark):
    t = tables(spark,
               transactions=[tx("T1", total=10.0), tx("T2", total=10.0), tx("T3", total=10.0),
                             tx("T4", total=10.0), tx("T5", total=3.0)],
               items=[item("a", "T1", price=10.0), item("b", "T2", price=10.01), item("c", "T3", price=10.02),
                      item("d", "T4", price=5.0, qty=3)])
    r = audit.header_line_reconciliation(t).first().asDict()
    assert r == {"total_transacciones": 4, "inconsistentes": 2, "pct_inconsistentes": 50.0,
                 "diferencia_promedio": 2.51, "diferencia_maxima": 5.0}


def test_uniqueness_counts_duplicates(spark):
    t = tables(spark, transactions=[tx("T1"), tx("T1"), tx("T2")])
    assert audit.uniqueness(t).first().asDict() == {"tabla": "trans", "total_registros": 3, "ids_unicos": 2,
                                                    "cant_duplicados": 1}


def test_validity_checks(spark):
    t = tables(spark, transactions=[tx("T1", total=0.0), tx("T2", total=-5.0), tx("T3", total=0.01)],
               items=[item("a", "T1", price=0.0, promo=False), item("b", "T1", price=0.0, promo=True),
                      item("c", "T1", price=0.0, promo=None)])
    assert [r["transaction_id"] for r in audit.non_positive_totals(t).collect()] == ["T2", "T1"]
    assert audit.zero_price_without_promo(t).first()[0] == 1


def test_orphans(spark):
    t = tables(spark, transactions=[tx("T1", store_id="S9"), tx("T2", store_id="S9"), tx("T3")],
               products=[product("I1", vendor="V1"), product("I2", vendor="VX"), product("I3", vendor="VX")],
               vendors=[vendor("V1")])
    assert audit.orphan_stores(t).first()[0] == 1
    assert rows(audit.orphan_vendors(t)) == [("VX", 2)]


def test_store_gaps_keep_seven_days_and_more(spark):
    days = ["2024-01-01", "2024-01-07", "2024-01-14", "2024-01-22", "2024-01-22"]
    t = tables(spark, transactions=[tx(f"T{i}", date=d) for i, d in enumerate(days)])
    out = [(r["fecha_inicio_gap"], r["fecha_fin_gap"], r["gap_dias"]) for r in audit.store_freshness_gaps(t).collect()]
    assert out == [(D("2024-01-14"), D("2024-01-22"), 8), (D("2024-01-07"), D("2024-01-14"), 7)]


def test_sales_before_opening(spark):
    t = tables(spark, stores=[store("S1", opening="2024-03-01")],
               transactions=[tx("T1", date="2024-02-29", total=12.5), tx("T2", date="2024-03-01")])
    r = audit.sales_before_opening(t).collect()
    assert [(x["store_id"], x["transacciones_antes_apertura"], x["total_amount_afectado"]) for x in r] == [("S1", 1, 12.5)]


def test_experiment_contamination_without_overlap_test(spark):
    t = tables(spark, promotions=[promo("S1", variant="CONTROL", start="2024-01-01", end="2024-01-31"),
                                  promo("S1", variant="TREATMENT", start="2024-06-01", end="2024-06-30"),
                                  promo("S2", variant="CONTROL")])
    assert rows(audit.experiment_contamination(t)) == [("S1", 2)]


def test_row_counts(spark):
    t = tables(spark, transactions=[tx("T1"), tx("T2")], items=[item("a", "T1")])
    got = dict((r["Table_Test"], r["Total"]) for r in audit.row_counts(t).collect())
    assert got == {"vendors": 1, "products": 1, "stores": 1, "store_promotions": 0, "transactions": 2,
                   "transaction_items": 1}
    assert isinstance(dt.date.today(), dt.date)
