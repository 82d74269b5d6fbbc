"""Data-quality audits A0–A8 over the raw tables.

Amount comparisons are exact: header and line amounts are decimals, so "differs
by more than one cent" means exactly that and sums do not depend on partition order.
Output names and labels are fixed values of the analyses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.money import as_money, exact, line_amount, round_half_away
from shelfspark.operators.gaps import consecutive_gaps
from shelfspark.sources.raw import RawTables
from shelfspark.sources.schemas import RAW


def row_counts(t: RawTables) -> DataFrame:
    """A0: rows per raw table."""
    order = ["vendors", "products", "stores", "store_promotions", "transactions", "transaction_items"]
    parts = [t.table(n).agg(F.count(F.lit(1)).alias("Total")).select(F.lit(n).alias("Table_Test"), "Total")
             for n in order if n in RAW]
    return reduce(DataFrame.unionByName, parts)


def completeness(t: RawTables) -> DataFrame:
    """A1: card holders vs anonymous transactions and their consistency."""
    tx = t.transactions
    no_card = F.col("loyalty_card") == F.lit(False)
    card = F.col("loyalty_card") == F.lit(True)
    no_id = F.col("customer_id").isNull()
    n = F.count(F.lit(1))
    return tx.agg(
        F.count_if(no_card).alias("loyalty_false"),
        F.count_if(card).alias("loyalty_true"),
        round_half_away(F.count_if(no_card) / n * 100, 1).alias("POR_loyalty_false"),
        round_half_away(F.count_if(card) / n * 100, 1).alias("POR_loyalty_true"),
        F.count_if(no_card & no_id).alias("loyalty_false_sin_id"),
        F.count_if(card & no_id).alias("inconsistencia_critica"))


def header_line_reconciliation(t: RawTables) -> DataFrame:
    """A2: transactions whose header total differs from the sum of their lines
    by more than the tolerance (transactions without lines are left out)."""
    lines = (t.transaction_items
             .groupBy("transaction_id")
             .agg(F.sum(line_amount("unit_price", "quantity")).alias("lines_c")))
    diff = (t.transactions.select("transaction_id", exact("total_amount").alias("header_c"))
            .join(lines, "transaction_id")
            .select(F.abs(F.col("header_c") - F.col("lines_c")).alias("d")))
    bad = F.col("d") > exact(F.lit(t.rules.reconciliation_tolerance))
    n, n_bad = F.count(F.lit(1)), F.count_if(bad)
    return diff.agg(
        n.alias("total_transacciones"),
        n_bad.alias("inconsistentes"),
        round_half_away(n_bad / n * 100, 1).alias("pct_inconsistentes"),
        round_half_away(as_money(F.sum(F.when(bad, F.col("d")))) / F.nullif(n_bad, F.lit(0)), 2)
        .alias("diferencia_promedio"),
        round_half_away(as_money(F.max("d")), 2).alias("diferencia_maxima"))


def reconciliation_drilldown(t: RawTables, transaction_id: str | None = None) -> DataFrame:
    """A2 drill-down: the lines of one transaction next to its header amount.
    Without an id, the transaction with the largest header/line difference
    (ties: smallest id) is chosen from the data."""
    lines = t.transaction_items.select(
        "transaction_id", "transaction_item_id", "quantity", "unit_price",
        as_money(line_amount("unit_price", "quantity")).alias("items_total_amount"))
    header = t.transactions.select("transaction_id", "total_amount")
    if transaction_id is None:
        per_tx = (t.transaction_items.groupBy("transaction_id")
                  .agg(F.sum(line_amount("unit_price", "quantity")).alias("lines_c"))
                  .join(header, "transaction_id")
                  .select("transaction_id",
                          F.abs(exact("total_amount") - F.col("lines_c")).alias("d")))
        pick = per_tx.agg(F.min_by("transaction_id", F.struct(-F.col("d"), F.col("transaction_id")))).scalar()
        target = F.col("transaction_id") == pick
    else:
        target = F.col("transaction_id") == F.lit(transaction_id)
    return lines.filter(target).join(header.filter(target), "transaction_id")


def uniqueness(t: RawTables) -> DataFrame:
    """A3: total rows, distinct transaction ids, duplicates."""
    # Two-level distinct: one row per id first (partial aggregation removes
    # repeats map-side), then a global count of ids and of their rows.
    per_id = t.transactions.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.sum("n").alias("total_registros"),
        F.count("transaction_id").alias("ids_unicos"),
    ).select(F.lit("trans").alias("tabla"),
             F.coalesce(F.col("total_registros"), F.lit(0)).cast("bigint").alias("total_registros"),
             "ids_unicos",
             (F.coalesce(F.col("total_registros"), F.lit(0)) - F.col("ids_unicos")).cast("bigint")
             .alias("cant_duplicados"))


def distinct_transaction_ids(t: RawTables) -> DataFrame:
    """A3 exploration: the distinct transaction ids."""
    return t.transactions.select("transaction_id").distinct()


def non_positive_totals(t: RawTables) -> DataFrame:
    """A4.1: transactions with a zero or negative header amount."""
    return (t.transactions.filter(F.col("total_amount") <= 0)
            .select("transaction_id", "customer_id", "total_amount", "status", "transaction_date", "store_id")
            .orderBy("total_amount"))


def zero_price_without_promo(t: RawTables) -> DataFrame:
    """A4.2: lines priced at zero while not on promotion (NULL promo is not counted)."""
    return (t.transaction_items
            .filter((F.col("unit_price") == 0) & (F.col("was_on_promo") == F.lit(False)))
            .agg(F.count(F.lit(1)).alias("items_precio_cero_sin_promo")))


def orphan_stores(t: RawTables) -> DataFrame:
    """A5.1: distinct store ids of transactions missing from the store master."""
    return (t.transactions.select("store_id")
            .join(t.stores.select("store_id"), "store_id", "left_anti")
            .agg(F.count_distinct("store_id").alias("registros_huerfanos")))


def orphan_vendors(t: RawTables) -> DataFrame:
    """A5.2: vendor ids of products missing from the vendor master, with product counts."""
    return (t.products.select("vendor_id")
            .join(t.vendors.select("vendor_id"), "vendor_id", "left_anti")
            .groupBy("vendor_id").agg(F.count(F.lit(1)).alias("productos_afectados")))


def store_freshness_gaps(t: RawTables) -> DataFrame:
    """A6: gaps of at least ``freshness_gap_days`` between consecutive active days of a store."""
    days = t.transactions.select("store_id", "transaction_date").distinct()
    return (consecutive_gaps(days, ["store_id"], "transaction_date", min_gap=t.rules.freshness_gap_days)
            .select("store_id", F.col("prev_date").alias("fecha_inicio_gap"),
                    F.col("transaction_date").alias("fecha_fin_gap"), F.col("gap_days").alias("gap_dias"))
            .orderBy(F.col("gap_dias").desc()))


def sales_before_opening(t: RawTables) -> DataFrame:
    """A7: transactions dated before their store opened, per store."""
    stores = t.stores.select("store_id", "opening_date")
    return (t.transactions.join(stores, "store_id")
            .filter(F.col("transaction_date") < F.col("opening_date"))
            .groupBy("store_id", "opening_date")
            .agg(F.count(F.lit(1)).alias("transacciones_antes_apertura"),
                 F.min("transaction_date").alias("primera_tran_invalida"),
                 F.max("transaction_date").alias("ultima_tran_invalida"),
                 round_half_away(as_money(F.sum(exact("total_amount"))), 2).alias("total_amount_afectado"))
            .orderBy(F.col("transacciones_antes_apertura").desc()))


def experiment_contamination(t: RawTables) -> DataFrame:
    """A8: stores assigned to more than one experiment variant."""
    return (t.store_promotions.groupBy("store_id")
            .agg(F.count_distinct("variant").alias("num_variantes"))
            .filter(F.col("num_variantes") > 1))


AUDITS = {
    "a0_row_counts": row_counts,
    "a1_completeness": completeness,
    "a2_reconciliation": header_line_reconciliation,
    "a2p_reconciliation_drilldown": reconciliation_drilldown,
    "a3_uniqueness": uniqueness,
    "a3p_distinct_ids": distinct_transaction_ids,
    "a4_1_non_positive_totals": non_positive_totals,
    "a4_2_zero_price_no_promo": zero_price_without_promo,
    "a5_1_orphan_stores": orphan_stores,
    "a5_2_orphan_vendors": orphan_vendors,
    "a6_store_gaps": store_freshness_gaps,
    "a7_sales_before_opening": sales_before_opening,
    "a8_experiment_contamination": experiment_contamination,
}
