"""Reports B2, B4 and B5 re-stated on the star's clean-sales view (S9).

The view's definition of a clean sale is not the reports' shared filter: it
keeps zero-priced lines sold on promotion and drops lines of unknown vendors
everywhere, and it excludes flagged lines rather than filtering raw columns.
These jobs answer the same questions as B2/B4/B5 for users of the star and
make the difference between the two definitions measurable. Amounts are
summed as exact decimals of the fact's columns. None of them reads the customer
key, so they use the fact without the customer lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.dates import months_before
from shelfspark.functions.money import as_money, exact, line_amount, round_half_away, safe_div
from shelfspark.plans.reports import GMROI_OK, LOW_GMROI, LOW_PRODUCTIVITY, NORMAL
from shelfspark.plans.star import Star
from shelfspark.sources.raw import RawTables


def productivity_on_star(t: RawTables) -> DataFrame:
    """B2 on the star: last-months GMV and transactions per m², ticket, rank, P25 status."""
    r = t.rules
    star = Star(t)
    fact = star.fact_sales_without_customer
    last = fact.agg(F.max("transaction_date")).scalar()
    view = star.clean_sales(fact).filter(F.col("transaction_date") >= months_before(last, r.recent_months))
    attrs = ["store_key", "store_name", "country", "format", "size_sqm"]
    per_tx = view.groupBy(*attrs, "transaction_id").agg(F.sum(exact("gmv")).alias("amount"))
    per_store = per_tx.groupBy(*attrs).agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_tx"))
    gmv = as_money("amount")
    metrics = per_store.select(
        *attrs, gmv.alias("gmv_raw"),
        round_half_away(gmv / F.col("size_sqm"), 2).alias("gmv_por_m2"),
        round_half_away(F.col("n_tx") / F.col("size_sqm"), 4).alias("transacciones_por_m2"),
        round_half_away(gmv / F.col("n_tx"), 2).alias("ticket_promedio"))
    w_rank = Window.partitionBy("format").orderBy(F.col("gmv_por_m2").desc())
    return (metrics.withColumn("p25", F.percentile("gmv_por_m2", r.low_percentile).over(Window.partitionBy("format")))
            .select(*attrs, round_half_away("gmv_raw", 2).alias("gmv_trimestre"), "gmv_por_m2",
                    "transacciones_por_m2", "ticket_promedio",
                    F.rank().over(w_rank).cast("bigint").alias("ranking_formato"),
                    F.when(F.col("gmv_por_m2") <= F.col("p25"), F.lit(LOW_PRODUCTIVITY))
                     .otherwise(F.lit(NORMAL)).alias("estado_rendimiento"))
            .orderBy("format", F.col("gmv_por_m2").desc()))


def gmroi_on_star(t: RawTables) -> DataFrame:
    """B4 on the star: GMROI per vendor × category from the fact's margin and cost."""
    r = t.rules
    star = Star(t)
    view = star.clean_sales(star.fact_sales_without_customer)
    keys = ["vendor_id", "vendor_name", "category"]
    per_product = (view.groupBy(*keys, "product_key")
                   .agg(F.sum(exact("gmv")).alias("gmv_c"),
                        F.sum(line_amount("unit_cost", "quantity")).alias("cost_c"),
                        F.sum(exact("gross_margin")).alias("margin_c"),
                        F.sum("quantity").alias("units"),
                        F.min("transaction_date").alias("first_day"), F.max("transaction_date").alias("last_day")))
    agg = per_product.groupBy(*keys).agg(
        F.sum("gmv_c").alias("gmv_c"), F.sum("cost_c").alias("cost_c"), F.sum("margin_c").alias("margin_c"),
        F.count(F.lit(1)).alias("skus"), F.sum("units").alias("units"),
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    margin, cost = as_money("margin_c"), as_money("cost_c")
    ratio = safe_div(margin, cost)
    return (agg.select(*keys,
                       round_half_away(as_money("gmv_c"), 2).alias("gmv"),
                       round_half_away(cost, 2).alias("costo_total"),
                       round_half_away(margin, 2).alias("margen_bruto"),
                       round_half_away(ratio, 4).alias("gmroi"),
                       F.col("skus").cast("bigint").alias("skus_activos"),
                       round_half_away(safe_div(F.col("units"), F.datediff("last_day", "first_day")), 2)
                       .alias("velocidad_venta_unidades_dia"),
                       F.when(ratio < r.gmroi_floor, F.lit(LOW_GMROI)).otherwise(F.lit(GMROI_OK)).alias("estado_gmroi"))
            .orderBy(F.col("gmroi").asc_nulls_first()))


def stockouts_on_star(t: RawTables) -> DataFrame:
    """B5 on the star: selling-day gaps per (store, product) of the clean view."""
    r = t.rules
    star = Star(t)
    daily = (star.clean_sales(star.fact_sales_without_customer)
             .groupBy("store_key", "product_key", "transaction_date")
             .agg(F.sum("quantity").alias("units"), F.sum(exact("gmv")).alias("amount")))
    names = star.dim_product.select("product_key", "item_name", "category")
    part = Window.partitionBy("store_key", "product_key")
    gaps = (daily.withColumn("prev_date", F.lag("transaction_date").over(part.orderBy("transaction_date")))
            .withColumn("n_days", F.count(F.lit(1)).over(part))
            .withColumn("units_total", F.sum("units").over(part))
            .withColumn("amount_total", F.sum("amount").over(part))
            .withColumn("gap_days", F.datediff("transaction_date", "prev_date"))
            .filter((F.col("gap_days") >= r.stockout_gap_days) & (F.col("n_days") >= r.stockout_min_selling_days)))
    return (gaps.join(names, "product_key").select("store_key", "product_key", "item_name", "category",
                        F.col("prev_date").alias("fecha_inicio_gap"), F.col("transaction_date").alias("fecha_fin_gap"),
                        F.col("gap_days").cast("bigint").alias("duracion_dias"),
                        round_half_away(F.col("units_total") / F.col("n_days"), 2).alias("ventas_promedio_diarias"),
                        round_half_away(as_money("amount_total") / F.col("n_days") * (F.col("gap_days") - 1), 2)
                        .alias("gmv_estimado_perdido"))
            .orderBy(F.col("gmv_estimado_perdido").desc()))


STAR_REPORTS = {
    "b2s_productivity_on_star": productivity_on_star,
    "b4s_gmroi_on_star": gmroi_on_star,
    "b5s_stockouts_on_star": stockouts_on_star,
}
