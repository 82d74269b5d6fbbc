"""Retail tables derived from the driver's TPC-H-style tables.

The analyses expect the six raw retail tables. The test environment provides
``region nation customer supplier part orders lineitem`` instead, so this module
derives the retail tables from them with plain column expressions and joins.
All derivation stays lazy: Catalyst fuses it into each job's plan, prunes the
columns a job does not use and pushes filters down to the Parquet scans.

``SQL_PRELUDE`` is the same derivation as SQL common table expressions, for the
independent DuckDB oracle. The two must stay in step.

Mapping (a design of this repository):

* stores — one per nation, joined to its region.
* transactions — one per order, every 1,499th twice; the store is the customer's
  nation, or one that is not in the master; two out of five customers carry a
  loyalty card and only they have a customer id, which every 307th order lacks;
  every 997th order has a zero total; every tenth partially-filled order is a return.
* transaction_items — one per lineitem; the SKU is (part type, brand); the unit
  price is the line price per unit with four decimals, zero when the line has no
  tax and either no discount or the highest one; lines with a discount of 9 % or
  more are on promotion.
* item_feed — the lines with their header; one part in five was first reported
  with one unit more, a day earlier, half of them for a sale date a week before.
* products — one per SKU; the vendor follows the SKU's lowest part key over one
  vendor more than there are suppliers (an orphan vendor).
* vendors — the suppliers.
* store_promotions — one per supplier: its nation's store, three campaign
  names, CONTROL/TREATMENT by parity, sixty-day periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Fixed values of the derivation.
EPOCH = "1995-01-01"
STORE_OPENING_STEP_DAYS = 100
PROMO_STEP_DAYS = 20
PROMO_LENGTH_DAYS = 60
UNKNOWN_STORE = "ST_999"
#: The column that all versions of a line share in ``item_feed``.
VERSIONS_SHARE = ("transaction_id",)


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _store_id(nationkey: str):
    return F.concat(F.lit("ST_"), F.lpad(F.col(nationkey).cast("string"), 3, "0"))


def _sku(ptype: str = "p_type", brand: str = "p_brand"):
    return F.concat(F.col(ptype), F.lit("_"), F.col(brand))


def _transaction_id(orderkey: str):
    return F.concat(F.lit("TX_"), F.col(orderkey).cast("string"))


def _vendor_id(number):
    return F.concat(F.lit("VND_"), F.lpad((number + 1).cast("string"), 9, "0"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_driver(spark, sf_dir, "nation")
    region = read_driver(spark, sf_dir, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey)
            .select(_store_id("n_nationkey").alias("store_id"),
                    F.col("n_name").alias("store_name"),
                    F.col("r_name").alias("country"),
                    F.col("n_name").alias("city"),
                    F.concat(F.lit("FMT_"), (F.col("n_nationkey") % 4).cast("string")).alias("format"),
                    (F.lit(200) + F.col("n_nationkey") * 50).cast("bigint").alias("size_sqm"),
                    F.date_add(F.lit(EPOCH).cast("date"),
                               (F.col("n_nationkey") * STORE_OPENING_STEP_DAYS).cast("int")).alias("opening_date"),
                    F.col("r_name").alias("region")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_driver(spark, sf_dir, "orders")
    customer = read_driver(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    loyal = (F.col("o_custkey") % 5) < 2
    copies = F.when(F.col("o_orderkey") % 1499 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .withColumn("_copy", F.explode(copies))
            .select(_transaction_id("o_orderkey").alias("transaction_id"),
                    F.when(F.col("o_custkey") % 211 == 7, F.lit(UNKNOWN_STORE))
                     .otherwise(_store_id("c_nationkey")).alias("store_id"),
                    F.when(loyal & (F.col("o_orderkey") % 307 != 1),
                           F.concat(F.lit("CU_"), F.col("o_custkey").cast("string"))).alias("customer_id"),
                    F.col("o_orderdate").cast("date").alias("transaction_date"),
                    F.when(F.col("o_orderkey") % 997 == 0, F.lit(0.0))
                     .otherwise(F.col("o_totalprice")).alias("total_amount"),
                    F.col("o_orderpriority").alias("payment_method"),
                    loyal.alias("loyalty_card"),
                    F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0), F.lit("RETURNED"))
                     .otherwise(F.lit("COMPLETED")).alias("status")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their part's type and brand, in the driver's columns: what crosses a shuffle before ids are spelled out.
    Of tax and discount only what they decide crosses."""
    free = (F.col("l_tax") == 0) & ((F.col("l_discount") == 0) | (F.col("l_discount") >= 0.1))
    li = read_driver(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", free.alias("free"),
        (F.col("l_discount") >= 0.09).alias("was_on_promo"), "l_shipdate")
    part = read_driver(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return li.join(part, li.l_partkey == part.p_partkey)


def _line_columns() -> dict[str, Column]:
    qty = F.col("l_quantity").cast("bigint")
    unit = F.floor(F.round(F.col("l_extendedprice") * 100).cast("bigint") * 100 / qty).cast("bigint")
    return {
        "transaction_item_id": F.concat_ws("_", F.lit("TI"), F.col("l_orderkey").cast("string"),
                                           F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                                           F.col("l_suppkey").cast("string")),
        "item_id": _sku(),
        "quantity": qty,
        "unit_price": F.when(F.col("free"), F.lit(0.0)).otherwise(unit / F.lit(10000.0)),
        "was_on_promo": F.col("was_on_promo"),
        "corrected": F.col("l_partkey") % 5 == 0,
        "moved": F.col("l_partkey") % 10 == 0,
        "ingestion_timestamp": F.col("l_shipdate").cast("timestamp_ntz"),
    }


def transaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _line_columns()
    return _lines(spark, sf_dir).select(
        c["transaction_item_id"].alias("transaction_item_id"), _transaction_id("l_orderkey").alias("transaction_id"),
        *[c[n].alias(n) for n in ("item_id", "quantity", "unit_price", "was_on_promo")])


def item_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point-of-sale export as the incremental pipeline receives it: one
    row per line *version*, header columns repeated, with its ingestion time.

    The ship timestamp plays the ingestion time of a line's last version, which
    is the line of ``transaction_items``; ``source_record_id`` identifies the
    physical record (tie-breaker). A line's id begins with its order's key, so its
    versions share their transaction (``VERSIONS_SHARE``); lines meet their header
    by the transaction id, which is spelled out after the shuffle."""
    lines, headers = _lines(spark, sf_dir), transactions(spark, sf_dir)
    joined = lines.join(headers, _transaction_id("l_orderkey") == headers.transaction_id)
    rows = joined.select(*headers.columns, *[c.alias(n) for n, c in _line_columns().items()])
    versions = F.when(F.col("corrected"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    older = (F.col("version") == 1).cast("int")
    return (rows.withColumn("version", F.explode(versions))
            .select("transaction_item_id", "transaction_id", "store_id",
                    "customer_id", F.date_sub("transaction_date", F.when(F.col("moved"), 7 * older).otherwise(0)).alias("transaction_date"),
                    "total_amount", "payment_method", "loyalty_card", "status", "item_id", (F.col("quantity") + older).alias("quantity"), "unit_price", "was_on_promo",
                    F.when(older == 1, F.col("ingestion_timestamp") - F.expr("INTERVAL 1 DAY"))
                     .otherwise(F.col("ingestion_timestamp")).alias("ingestion_timestamp"),
                    F.concat_ws("_", "transaction_item_id", F.col("version").cast("string")).alias("source_record_id")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_driver(spark, sf_dir, "part")
    vendors_and_one = read_driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1)) + 1).scalar()
    per_sku = part.groupBy("p_type", "p_brand").agg(
        F.min("p_partkey").alias("min_key"), F.min("p_retailprice").alias("min_price"))
    cost_cents = F.floor(F.round(F.col("min_price") * 100).cast("bigint") * 5 / 2).cast("bigint")
    return per_sku.select(
        _sku().alias("item_id"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("item_name"),
        F.col("p_brand").alias("brand"),
        _vendor_id(F.col("min_key") % vendors_and_one).alias("vendor_id"),
        F.col("p_type").alias("category"),
        F.col("p_type").alias("department"),
        (cost_cents / F.lit(100.0)).alias("cost"))


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_driver(spark, sf_dir, "supplier")
    nation = read_driver(spark, sf_dir, "nation")
    return (supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .select(_vendor_id(F.col("s_suppkey")).alias("vendor_id"),
                    F.col("s_name").alias("vendor_name"),
                    F.col("n_name").alias("country"),
                    F.when(F.col("s_acctbal") > 5000, F.lit("A")).otherwise(F.lit("B")).alias("tier"),
                    (F.col("s_suppkey") % 2 == 0).alias("is_shared_catalog")))


def store_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_driver(spark, sf_dir, "supplier")
    start = F.date_add(F.lit(EPOCH).cast("date"), (F.col("s_suppkey") * PROMO_STEP_DAYS).cast("int"))
    return supplier.select(
        _store_id("s_nationkey").alias("store_id"),
        F.concat(F.lit("P"), (F.col("s_suppkey") % 3).cast("string")).alias("promo_name"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("CONTROL")).otherwise(F.lit("TREATMENT")).alias("variant"),
        start.alias("start_date"),
        F.date_add(start, PROMO_LENGTH_DAYS).alias("end_date"),
        F.lit("AB").alias("promo_type"))


BUILDERS = {
    "transactions": transactions,
    "transaction_items": transaction_items,
    "stores": stores,
    "products": products,
    "vendors": vendors,
    "store_promotions": store_promotions,
}


# The same derivation for DuckDB (oracle side). Integer division is written
# as floor of a double quotient on both sides: both engines evaluate it exactly
# for the magnitudes involved.
SQL_PRELUDE = f"""
stores AS (
  SELECT 'ST_' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS store_id,
         n_name AS store_name, r_name AS country, n_name AS city,
         'FMT_' || CAST(n_nationkey % 4 AS VARCHAR) AS format,
         CAST(200 + n_nationkey * 50 AS BIGINT) AS size_sqm,
         CAST(DATE '{EPOCH}' + CAST(n_nationkey * {STORE_OPENING_STEP_DAYS} AS INTEGER) AS DATE) AS opening_date,
         r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
transactions AS (
  SELECT 'TX_' || CAST(o_orderkey AS VARCHAR) AS transaction_id,
         CASE WHEN o_custkey % 211 = 7 THEN '{UNKNOWN_STORE}' ELSE 'ST_' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') END AS store_id,
         CASE WHEN o_custkey % 5 < 2 AND o_orderkey % 307 <> 1 THEN 'CU_' || CAST(o_custkey AS VARCHAR) END AS customer_id,
         CAST(o_orderdate AS DATE) AS transaction_date,
         CASE WHEN o_orderkey % 997 = 0 THEN 0.0 ELSE o_totalprice END AS total_amount,
         o_orderpriority AS payment_method,
         o_custkey % 5 < 2 AS loyalty_card,
         CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'RETURNED' ELSE 'COMPLETED' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN range(1, 3) AS copy(n) ON copy.n = 1 OR o_orderkey % 1499 = 3
),
line_rows AS (
  SELECT 'TI_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) || '_'
           || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR) AS transaction_item_id,
         'TX_' || CAST(l_orderkey AS VARCHAR) AS transaction_id,
         p_type || '_' || p_brand AS item_id,
         CAST(l_quantity AS BIGINT) AS quantity,
         CASE WHEN l_tax = 0 AND (l_discount = 0 OR l_discount >= 0.1) THEN 0.0
              ELSE CAST(floor(CAST(round(l_extendedprice * 100) AS BIGINT) * 100 / CAST(l_quantity AS BIGINT)) AS BIGINT) / 10000.0
         END AS unit_price,
         l_discount >= 0.09 AS was_on_promo,
         l_partkey % 5 = 0 AS corrected,
         l_partkey % 10 = 0 AS moved,
         CAST(l_shipdate AS TIMESTAMP) AS ingestion_timestamp
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
transaction_items AS (
  SELECT transaction_item_id, transaction_id, item_id, quantity, unit_price, was_on_promo FROM line_rows
),
item_feed AS (
  SELECT l.transaction_item_id, t.transaction_id, t.store_id, t.customer_id,
         CASE WHEN version.n = 1 AND l.moved THEN CAST(t.transaction_date - INTERVAL 7 DAY AS DATE) ELSE t.transaction_date END AS transaction_date,
         t.total_amount, t.payment_method,
         t.loyalty_card, t.status, l.item_id,
         CASE WHEN version.n = 1 THEN l.quantity + 1 ELSE l.quantity END AS quantity, l.unit_price, l.was_on_promo,
         CASE WHEN version.n = 1 THEN l.ingestion_timestamp - INTERVAL 1 DAY ELSE l.ingestion_timestamp END AS ingestion_timestamp,
         l.transaction_item_id || '_' || CAST(version.n AS VARCHAR) AS source_record_id
  FROM line_rows l JOIN transactions t USING (transaction_id)
  JOIN range(1, 3) AS version(n) ON version.n = 2 OR l.corrected
),
products AS (
  SELECT p_type || '_' || p_brand AS item_id,
         p_type || ' ' || p_brand AS item_name,
         p_brand AS brand,
         'VND_' || lpad(CAST(min(p_partkey) % (SELECT count(*) + 1 FROM supplier) + 1 AS VARCHAR), 9, '0') AS vendor_id,
         p_type AS category, p_type AS department,
         CAST(floor(CAST(round(min(p_retailprice) * 100) AS BIGINT) * 5 / 2) AS BIGINT) / 100.0 AS cost
  FROM part GROUP BY p_type, p_brand
),
vendors AS (
  SELECT 'VND_' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') AS vendor_id,
         s_name AS vendor_name, n_name AS country,
         CASE WHEN s_acctbal > 5000 THEN 'A' ELSE 'B' END AS tier,
         s_suppkey % 2 = 0 AS is_shared_catalog
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
store_promotions AS (
  SELECT 'ST_' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS store_id,
         'P' || CAST(s_suppkey % 3 AS VARCHAR) AS promo_name,
         CASE WHEN s_suppkey % 2 = 0 THEN 'CONTROL' ELSE 'TREATMENT' END AS variant,
         CAST(DATE '{EPOCH}' + CAST(s_suppkey * {PROMO_STEP_DAYS} AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '{EPOCH}' + CAST(s_suppkey * {PROMO_STEP_DAYS} + {PROMO_LENGTH_DAYS} AS INTEGER) AS DATE) AS end_date,
         'AB' AS promo_type
  FROM supplier
)"""
