"""Jobs on the analyses' tables for sizes at which the plain forms would meet a limit: overlapping experiments without
pairing promotions, percentiles over every basket, retention from kept bitmaps, the fact's join with hot transactions split,
and reconciliation that reads only what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.dates import month_start, months_before
from shelfspark.functions.money import as_money, round_half_away
from shelfspark.operators.bitmaps import counted, key_sets, shared, united
from shelfspark.operators.fingerprints import differences
from shelfspark.operators.percentile import exact_percentiles
from shelfspark.operators.split_join import split_join
from shelfspark.operators.sweep import class_overlaps
from shelfspark.plans.common import last_sale_date, valid_sales
from shelfspark.plans.pipeline import latest_versions
from shelfspark.plans.reports import basket_sales
from shelfspark.plans.star import Star
from shelfspark.session import scratch_table
from shelfspark.sources.raw import RawTables


# ---- A8: overlapping experiments -------------------------------------------------

def variant_overlaps(t: RawTables) -> DataFrame:
    """A8 by time: the stretches of days on which a store is in more than one variant (``experiment_contamination`` tells
    only that it ever was)."""
    found = class_overlaps(t.store_promotions, ["store_id"], "variant", "start_date", "end_date")
    return found.select("store_id", F.col("overlap_start").alias("fecha_inicio"), F.col("overlap_end").alias("fecha_fin"),
                        F.col("days").alias("dias"), F.col("most").alias("num_variantes"))


# ---- B2: percentiles of baskets ----------------------------------------------------

QUANTILES = (0.25, 0.5, 0.9)


def basket_percentiles(t: RawTables) -> DataFrame:
    """B2's ticket as a distribution: exact percentiles of the basket values per store format, over all baskets of the last
    ``recent_months``."""
    since = months_before(last_sale_date(t), t.rules.recent_months)
    baskets = (basket_sales(t, since=since).groupBy("store_id", "transaction_id").agg(as_money(F.sum("line_amount")).alias("ticket")))
    formats = t.stores.select("store_id", "format")
    found = exact_percentiles(baskets.join(formats, "store_id"), ["format"], "ticket", QUANTILES)
    wide = found.groupBy("format").agg(F.max("n").alias("transacciones"), *[
        round_half_away(F.max(F.when(F.col("q") == q, F.col("percentile"))), 4).alias(f"ticket_p{round(q * 100)}") for q in QUANTILES])
    return wide.withColumn("transacciones", F.col("transacciones").cast("bigint"))


# ---- B3: retention from bitmaps -----------------------------------------------------

def activity_sets(t: RawTables, star: Star) -> DataFrame:
    """The card holders with a valid sale, per day: a kept state that a day's load appends to."""
    visits = valid_sales(t).filter(F.col("loyalty_card") & F.col("customer_id").isNotNull())
    visits = visits.select("transaction_date", "customer_id", "loyalty_card")
    return key_sets(star.customer_lookup(visits), ["transaction_date"], "customer_key")


def cohort_sets(star: Star) -> DataFrame:
    """The card holders of each acquisition month."""
    return key_sets(star.dim_customer, ["cohort_month"], "customer_key")


def retention(activity: DataFrame, cohorts: DataFrame, months: tuple[int, ...]) -> DataFrame:
    """Per cohort its size and the members active in the given months after it, from the sets alone."""
    sizes = counted(cohorts, ["cohort_month"], "cohort_size")
    monthly = united(activity, [month_start("transaction_date").alias("month")])
    wanted = cohorts.withColumn("month_number", F.explode(F.array(*[F.lit(m) for m in months]))).withColumn("month", F.add_months("cohort_month", F.col("month_number")))
    active = counted(shared(wanted, monthly, ["month"], ["cohort_month", "month_number"]), ["cohort_month", "month_number"], "active")
    return sizes.join(active, "cohort_month", "left")


def retention_from_bitmaps(t: RawTables) -> DataFrame:
    """B3's cohort sizes and retention percentages from bitmaps of dense customer keys."""
    star, months = Star(t), t.rules.cohort_months
    found = retention(activity_sets(t, star), cohort_sets(star), tuple(sorted({0, *months})))
    cols = [round_half_away(F.max(F.when((F.col("month_number") == m) & (F.col("active") > 0), F.col("active"))) / F.col("cohort_size") * 100, 1)
            .alias(f"POR_retention_mes_{m}") for m in months]
    return (found.filter(F.col("active") > 0).groupBy("cohort_month", "cohort_size").agg(*cols)
            .withColumn("cohort_month", F.date_format("cohort_month", "yyyy-MM")))


# ---- S8: the fact's join with hot transactions split -----------------------------------

def fact_join_split(t: RawTables, part_rows: int = 1_000_000) -> DataFrame:
    """S8's join of lines and headers, hot transactions split; without surrogate keys."""
    lines = t.transaction_items.join(t.products.select("item_id"), "item_id", "left_semi")
    headers = t.transactions.join(t.stores.select("store_id"), "store_id", "left_semi").select(
        "transaction_id", "store_id", "transaction_date", "status")
    return split_join(lines, headers, "transaction_id", "transaction_item_id", part_rows).select(
        "transaction_item_id", "transaction_id", "item_id", "store_id", "transaction_date", "status", "quantity", "unit_price")


def fact_join_split_small_parts(t: RawTables) -> DataFrame:
    """``fact_join_split`` with parts so small that the largest baskets are split."""
    return fact_join_split(t, part_rows=5)


# ---- P8: reconciliation by fingerprints -------------------------------------------------

# What a differing line is.
ONLY_FEED, ONLY_SALES, REPEATED, DIFFERENT = "SOLO_FEED", "SOLO_VENTAS", "REPETIDO", "DISTINTO"
COMPARED = ("transaction_id", "store_id", "item_id", "status", "quantity", "unit_price")


def fingerprint_reconciliation(t: RawTables) -> DataFrame:
    """P8 line by line: where the feed's latest versions and the sales tables do not hold the same lines. Days and key
    buckets with equal fingerprints are not read again. Both sides are derived once and written for the passes over them."""
    columns = ["transaction_date", "transaction_item_id", *COMPARED]
    feed = scratch_table(latest_versions(t).select(columns), "latest-lines")
    sales = scratch_table(t.transaction_items.join(t.transactions, "transaction_id").select(columns), "sold-lines")
    found = differences(feed, sales, "transaction_item_id", "transaction_date", COMPARED)
    kind = (F.when(F.col("n_b") == 0, ONLY_FEED).when(F.col("n_a") == 0, ONLY_SALES)
            .when(F.col("same") >= F.least("n_a", "n_b"), REPEATED).otherwise(DIFFERENT))
    return found.select("transaction_date", "transaction_item_id", F.col("n_a").alias("en_feed"), F.col("n_b").alias("en_ventas"),
                        kind.alias("diferencia"))


SCALED_JOBS = {
    "a8_variant_overlaps": variant_overlaps,
    "b2_basket_percentiles": basket_percentiles,
    "b3_retention_bitmaps": retention_from_bitmaps,
    "s8_fact_join_split": fact_join_split_small_parts,
    "p8_fingerprint_reconciliation": fingerprint_reconciliation,
}
