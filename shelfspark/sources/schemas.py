"""Declared schemas of the raw retail tables and of the star schema.

Nothing is inferred at run time: CSV and Parquet readers are given these
schemas, and star tables are written with them. Parquet reads every column as
nullable, so the NOT NULL contract of the star is checked by
``shelfspark.operators.checks.assert_not_null`` instead.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B, DT = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType()


def _schema(*fields, comments: dict[str, str] | None = None) -> T.StructType:
    comments = comments or {}
    return T.StructType([
        T.StructField(name, typ, nullable, {"comment": comments[name]} if name in comments else {})
        for name, typ, nullable in fields
    ])


# ---- raw tables -----------------------------------------------------------

TRANSACTIONS = _schema(
    ("transaction_id", S, False), ("store_id", S, False), ("customer_id", S, True),
    ("transaction_date", DT, False), ("total_amount", D, True), ("payment_method", S, False),
    ("loyalty_card", B, True), ("status", S, False),
)

TRANSACTION_ITEMS = _schema(
    ("transaction_item_id", S, False), ("transaction_id", S, False), ("item_id", S, False),
    ("quantity", L, False), ("unit_price", D, False), ("was_on_promo", B, True),
)

STORES = _schema(
    ("store_id", S, False), ("store_name", S, False), ("country", S, False), ("city", S, False),
    ("format", S, False), ("size_sqm", L, False), ("opening_date", DT, False), ("region", S, False),
)

PRODUCTS = _schema(
    ("item_id", S, False), ("item_name", S, False), ("brand", S, True), ("vendor_id", S, True),
    ("category", S, False), ("department", S, True), ("cost", D, False),
)

VENDORS = _schema(
    ("vendor_id", S, False), ("vendor_name", S, False), ("country", S, False), ("tier", S, False),
    ("is_shared_catalog", B, False),
)

STORE_PROMOTIONS = _schema(
    ("store_id", S, False), ("promo_name", S, False), ("variant", S, False),
    ("start_date", DT, False), ("end_date", DT, False), ("promo_type", S, False),
)

RAW = {
    "transactions": TRANSACTIONS,
    "transaction_items": TRANSACTION_ITEMS,
    "stores": STORES,
    "products": PRODUCTS,
    "vendors": VENDORS,
    "store_promotions": STORE_PROMOTIONS,
}

# Small master tables: bounded by the business (stores, catalogue, suppliers,
# campaigns), never by sales volume. Their size is still measured before a
# broadcast (see RawTables.dim).
DIMENSIONS = ("stores", "products", "vendors", "store_promotions")

# ---- star schema ----------------------------------------------------------

DIM_DATE = _schema(
    ("date_key", L, False), ("full_date", DT, False), ("year", L, False), ("quarter", L, False),
    ("month", L, False), ("month_name", S, False), ("week_of_year", L, False),
    ("day_of_week", L, False), ("day_name", S, False), ("is_weekend", B, False),
    ("is_holiday_CR", B, False), ("is_holiday_GT", B, False), ("is_holiday_HN", B, False),
    ("is_holiday_SV", B, False), ("is_holiday_NI", B, False), ("fiscal_period", S, False),
    comments={"date_key": "PK surrogate YYYYMMDD", "full_date": "calendar date"},
)

DIM_VENDOR = _schema(
    ("vendor_key", L, False), ("vendor_id", S, False), ("vendor_name", S, False),
    ("country", S, False), ("tier", S, False), ("is_shared_catalog", B, False), ("is_valid", B, False),
    comments={"vendor_key": "PK surrogate"},
)

DIM_PRODUCT = _schema(
    ("product_key", L, False), ("item_id", S, False), ("item_name", S, False), ("brand", S, True),
    ("vendor_key", L, False), ("vendor_id", S, False), ("category", S, False),
    ("department", S, True), ("cost", D, False), ("is_orphan_vendor", B, False),
    comments={"product_key": "PK surrogate"},
)

DIM_STORE = _schema(
    ("store_key", L, False), ("store_id", S, False), ("store_name", S, False), ("country", S, False),
    ("city", S, False), ("format", S, False), ("size_sqm", L, False), ("opening_date", DT, False),
    ("region", S, False), ("is_comparable", B, False), ("valid_from", DT, False),
    ("valid_to", DT, True), ("is_current", B, False),
    comments={"store_key": "PK surrogate"},
)

DIM_CUSTOMER = _schema(
    ("customer_key", L, False), ("customer_id_hashed", S, False), ("cohort_month", DT, False),
    ("first_transaction_date", DT, False), ("acquisition_store_key", L, True),
    ("acquisition_country", S, True),
    comments={"customer_key": "PK surrogate"},
)

DIM_PROMOTION = _schema(
    ("promotion_key", L, False), ("store_id", S, False), ("promo_name", S, False),
    ("variant", S, False), ("start_date", DT, False), ("end_date", DT, False),
    ("promo_type", S, False), ("is_contaminated", B, False),
    comments={"promotion_key": "PK surrogate"},
)

BRIDGE_PROMOTION = _schema(("transaction_id", S, False), ("promotion_key", L, False))

FACT_SALES = _schema(
    ("transaction_item_id", S, False), ("transaction_id", S, False), ("transaction_date", DT, False),
    ("transaction_date_key", L, False), ("store_key", L, False), ("product_key", L, False),
    ("customer_key", L, True), ("payment_method", S, False), ("loyalty_card", B, False),
    ("status", S, False), ("quantity", L, False), ("unit_price", D, False), ("gmv", D, False),
    ("unit_cost", D, False), ("gross_margin", D, False), ("was_on_promo", B, False),
    ("total_amount_reported", D, True), ("data_quality_flag", S, True), ("late_arrival", B, True),
)

# The point-of-sale feed of the incremental pipeline: one row per line version.
# Ingestion time is a wall-clock timestamp without time zone, as exported.
ITEM_FEED = _schema(
    ("transaction_item_id", S, False), ("transaction_id", S, False), ("store_id", S, False),
    ("customer_id", S, True), ("transaction_date", DT, False), ("total_amount", D, True),
    ("payment_method", S, False), ("loyalty_card", B, True), ("status", S, False),
    ("item_id", S, False), ("quantity", L, False), ("unit_price", D, False), ("was_on_promo", B, True),
    ("ingestion_timestamp", T.TimestampNTZType(), False), ("source_record_id", S, False),
)

STAR = {
    "dim_date": DIM_DATE,
    "dim_vendor": DIM_VENDOR,
    "dim_product": DIM_PRODUCT,
    "dim_store": DIM_STORE,
    "dim_customer": DIM_CUSTOMER,
    "dim_promotion": DIM_PROMOTION,
    "bridge_promotion": BRIDGE_PROMOTION,
    "fact_sales": FACT_SALES,
}
